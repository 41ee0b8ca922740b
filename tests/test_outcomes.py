"""Answers to requests, SQL over interaction rows, areas by group, and intakes that lag behind."""

import random

import pytest
from events import key, table
from pyspark.sql import functions as F

from keystride import session
from keystride.operators.timings import interactions, timed_rows
from keystride.plans import feature_build, monitoring, risk
from keystride.plans.session_features import activity_features, keystroke_features
from keystride.session import new_path
from keystride.streaming import ingest, sessions

REQUESTS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "x"), (6, None)]


def test_every_request_gets_one_answer(spark):
    asked = spark.createDataFrame(REQUESTS, "request_id long, session_id string")
    risks = spark.createDataFrame([("a", 0.8, "high"), ("b", 0.1, "low")], "session_id string, risk_score double, tier string")
    at = F.lit("2024-02-01").cast("timestamp")
    want = [
        (1, "a", "scored", None, 0.8, "high"), (2, "a", "scored", None, 0.8, "high"), (3, "", "refused", risk.NO_ID, None, None),
        (4, None, "refused", risk.NO_ID, None, None), (5, "x", "no_data", risk.NO_DATA, None, None), (6, None, "refused", risk.NO_ID, None, None),
    ]
    found = risk.answers(asked, risks, at)
    assert sorted(tuple(r)[:6] for r in found.collect()) == want
    assert {r.timestamp for r in found.collect()} == {"2024-02-01T00:00:00.000000Z"}
    assert risk.answers(asked.limit(0), risks, at).collect() == []
    path, out = new_path(spark, "in"), new_path(spark, "o")
    asked.write.parquet(path)
    stream = risk.answers(spark.readStream.schema(asked.schema).parquet(path), risks, at)
    ingest.start(stream.writeStream.format("parquet").option("path", out), new_path(spark, "c")).awaitTermination()
    assert sorted(tuple(r)[:6] for r in spark.read.parquet(out).collect()) == want


def test_sql_statement_sees_its_rows_only(spark):
    events = table(spark, [key("a", i, t, k) for i, (t, k) in enumerate([(0, "keydown"), (1, "keyup"), (3, "keydown")])])
    raw = interactions(timed_rows(events))
    before = {t.name for t in spark.catalog.listTables()}
    found = feature_build.sql_features(raw)
    want = activity_features(raw)
    assert found.select(*want.columns).collect() == want.collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    labels = spark.createDataFrame([("a", 1)], "session_id string, label int")
    joined = feature_build.sql_features(
        raw, "select label, count(*) as n from {raw} join {labels} using (session_id) where time_between_keystrokes > :least group by label",
        {"least": 1.5}, labels=labels,
    )
    assert [tuple(r) for r in joined.collect()] == [(1, 1)]


def plain_area(pairs):
    up, down = ([s for s, y in pairs if y == k] for k in (1, 0))
    if not up or not down:
        return None
    return sum((u > d) + (u == d) / 2 for u in up for d in down) / (len(up) * len(down))


@pytest.mark.parametrize("max_rows", [None, 10])
def test_area_of_every_group(spark, max_rows):
    rng = random.Random(2)
    rows = [(g, rng.choice([0.1, 0.25, 0.5]) if g == "ties" else rng.random(), rng.randrange(2)) for g in ["big"] * 300 + ["ties"] * 40 + ["small"] * 3]
    rows += [("one class", 0.5, 1), ("one class", 0.6, 1)]
    odd = [("big", None, 1), ("big", float("nan"), 0), ("big", 0.5, None), (None, 0.5, 1)]
    frame = spark.createDataFrame(rows + odd, "g string, risk_score double, label int").repartition(5)
    found = {r.group: r for r in monitoring.area_by_group(frame, F.col("g"), max_rows=max_rows).collect()}
    for group in ("big", "ties", "small", "one class"):
        pairs = [(s, y) for g, s, y in rows if g == group]
        want = plain_area(pairs)
        assert found[group].auc == (None if want is None else pytest.approx(want))
        assert found[group].positives + found[group].negatives == len(pairs)
    assert monitoring.area_by_group(frame.limit(0), F.col("g")).collect() == []


def test_sessions_wait_for_a_lagging_intake(spark):
    visits = table(spark, [key("a", i, t, "keydown") for i, t in enumerate((0, 20, 100, 110))] + [key("b", 0, 9000, "keydown")])
    later = table(spark, [key("z", 0, 20_000, "keydown")])
    path, out, checkpoint = new_path(spark, "rows"), new_path(spark, "o"), new_path(spark, "c")
    dated = visits.withColumn("event_date", F.to_date("event_time"))
    held = {"rows": dated.where("t <> 110")}

    def run():
        rows = spark.readStream.schema(visits.schema).parquet(path)
        closed = sessions.closed_sessions(rows, "31 seconds", "1 second")
        sessions.features_of_closed(closed, lambda: held["rows"], keystroke_features, out, checkpoint).awaitTermination()
        return {(r["session_id"], r["session_start"].minute, r["session_start"].second) for r in spark.read.parquet(out).collect()}

    visits.coalesce(1).write.parquet(path)
    assert run() == {("a", 0, 0)}
    held["rows"] = dated
    later.coalesce(1).write.mode("append").parquet(path)
    assert run() == {("a", 0, 0), ("a", 1, 40), ("b", 30, 0)}
    waiting = spark.read.parquet(f"{out}/_waiting/*")
    assert waiting.count() <= 2 and waiting.where("session_id = 'z'").isEmpty()


def test_only_intermediate_tables_are_discarded(spark, tmp_path):
    kept = str(tmp_path / "kept")
    spark.range(3).write.parquet(kept)
    with pytest.raises(ValueError):
        session.discard(spark.read.parquet(kept))
    made = session.materialise(spark.range(3), "gone")
    session.discard(made)
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(made.inputFiles()[0])
