"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_RUNS times; the median counts. Results go to
the noop sink, so all columns of all rows are computed.
"""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from keystride import session  # noqa: E402
from keystride.queries import QUERIES  # noqa: E402

HEADLINE = [
    "keystroke_features", "mouse_features", "session_features", "raw_behavioral",
    "session_sql_features", "hourly_features", "session_window_batch", "explode_events",
    "read_session_log", "dedup_events", "payload_validation", "scaled_features",
    "feature_contributions", "top_factors", "risk_report", "metrics_by_window", "risk_drift",
    "model_monitor", "iforest_score", "detector_predict", "session_risk", "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session.build(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
