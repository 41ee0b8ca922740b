"""What the physical plans must look like."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from keystride.plans import session_features as features
from keystride.queries import QUERIES
from keystride.session import shared_root
from keystride.sources import sample


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_features_need_one_exchange(spark, sf):
    text = plan(features.keystroke_features(sample.events(spark, sf, sample.KEY_TYPES)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "In(event_type, [click,view])" in text.split("PushedFilters")[1]


def test_session_features_add_only_the_session_side(spark, sf):
    text = plan(features.session_features(
        sample.events(spark, sf), sample.sessions(spark, sf)
    ))
    assert text.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", [
    "session_features", "session_sql_features", "top_factors", "risk_report",
    "feature_contributions", "ensemble_risk", "dedup_events", "payload_validation",
    "alert_rules", "risk_drift", "model_monitor", "hourly_features", "session_document",
])
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for operator in ("EvalPython", "CartesianProduct", "BroadcastNestedLoop", "InPandas"):
        assert operator not in text


def test_velocity_reads_only_its_columns(spark, sf):
    mouse = sample.events(spark, sf, sample.MOUSE_TYPES)
    text = plan(features.mouse_features(mouse))
    schema = text.split("ReadSchema")[1].splitlines()[0]
    assert "event_id" in schema and text.count("FileScan") == 1


def test_factors_and_reports_do_not_shuffle(spark, sf):
    assert "Exchange" not in plan(QUERIES["risk_report"](spark, sf))


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_root(Session())


def test_payloads_are_parsed_once(spark, tmp_path):
    from keystride.sources import payloads

    (tmp_path / "a.json").write_text('{"session_id": "a", "timestamp": "2024-01-01T00:00:00"}\n')
    text = plan(payloads.explode_events(payloads.read_log(spark, str(tmp_path))))
    assert text.count("FileScan json") == 1


def test_the_configured_folder_is_used():
    class Conf:
        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return "hdfs:///shared"

    class Session:
        conf = Conf()

    assert shared_root(Session()) == "hdfs:///shared"


def test_task_functions_need_no_installed_package(tmp_path):
    from keystride.plans import iforest

    pickled = tmp_path / "function"
    pickled.write_bytes(cloudpickle.dumps(iforest._grow))
    program = (
        "import pickle, sys, numpy as np;"
        f"grow = pickle.load(open({str(pickled)!r}, 'rb'));"
        "print(len(grow(np.arange(8.0).reshape(8, 1), 0, 1, 8)))"
    )
    done = subprocess.run(
        [sys.executable, "-c", program], cwd=tmp_path, capture_output=True, text=True,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert done.stdout.strip() == "15", done.stderr
