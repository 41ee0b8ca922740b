"""Missing codes, missing scores, one-class labels, wrong types, other time zones, lagging tables."""

import json

import pytest
from events import click, key, move, table
from pyspark.sql import functions as F

from keystride.functions.scalars import iso_timestamp
from keystride.operators.slicing import per_group, position
from keystride.operators.timings import timed_rows
from keystride.plans import monitoring
from keystride.plans.session_features import session_activity
from keystride.session import new_path
from keystride.sources import feature_store, payloads
from keystride.streaming.sessions import features_of_closed


@pytest.mark.parametrize("limit", [1, 7, 70])
def test_missing_codes_are_one_group_in_slices_too(spark, limit):
    rows = [key("a", i, float(i), "keydown" if i % 3 else "keyup", None if i % 2 else 65) for i in range(40)]
    rows += [key("b", i, float(i), "keydown", None) for i in range(5)] + [key("b", 5, 5.0, "keyup", None)]
    events = table(spark, rows)
    holds = lambda n: sorted((r.session_id, r.pos, r.hold) for r in timed_rows(events, n).where("hold is not null").collect())
    assert holds(limit) == holds(10_000)
    assert [h for s, _, h in holds(limit) if s == "b"] == [5.0, 4.0, 3.0, 2.0, 1.0]


@pytest.mark.parametrize("limit", [30, 100_000])
def test_documents_follow_one_rule_at_every_size(spark, limit):
    events = table(spark, [key("a", 1000 * i, i / 1000, "keydown") for i in range(4999)] + [key("b", 0, 7.0, "keyup")])
    none = spark.createDataFrame([], "session_id string, session_start double, device_info struct<screen_resolution: string>")
    docs = payloads.documents(events, none, max_rows=limit).collect()
    sizes = sorted(len(r.keystroke_data) for r in docs)
    assert sizes == [1, 49] + [50] * 99
    assert min(r.session_duration for r in docs) == 0.0


def test_positions_in_slices(spark):
    events = table(spark, [key("a", i, float(i // 3), "keydown") for i in range(50)])
    found = per_group(events, lambda rows: position(rows, "place", ["session_id"]), max_rows=7)
    assert sorted((r.pos, r.place) for r in found.collect()) == [(i, i) for i in range(50)]


def test_click_positions_do_not_wait_for_the_windows(spark):
    events = table(spark, [click("a", i, i, i % 4, 0) for i in range(20)] + [move("b", 0, 1, 1, 1)])
    found = session_activity(events)
    assert {r.session_id: r.distinct_click_positions for r in found.collect()} == {"a": 4, "b": 0}
    assert "mouse_click_position" in "".join(
        line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line)


def test_missing_scores_are_no_high_scores(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.1,), (-0.2,)], "risk_score double")
    assert {r.bin: r.current_share for r in monitoring.drift_bins(rows, rows).collect()} == {0: 0.5, 1: 0.5}
    assert monitoring.unscored_share(rows).first()[0] == 0.5


def test_wrong_types_are_quarantined(spark):
    good = {"session_id": "a", "timestamp": "2024-01-01T00:00:00Z", "keystroke_data": [{"event_type": "keydown", "key_code": 65, "timestamp": 1.0}]}
    bad = [dict(good, keystroke_data="text"), dict(good, keystroke_data=[{"event_type": "keydown", "key_code": "A", "timestamp": 1.0}]),
           dict(good, keystroke_data=[{"event_type": "keydown", "key_code": 65, "timestamp": 1e14}])]
    texts = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]], "raw string")
    parsed, rejected = payloads.accept(texts)
    assert parsed.count() == 1 and sorted(r.raw for r in rejected.collect()) == sorted(map(json.dumps, bad))


def test_keys_and_clicks_of_a_payload_have_places_of_their_own(spark):
    body = {"session_id": "a", "timestamp": "2024-01-01T00:00:00Z", "keystroke_data": [{"event_type": "keydown", "key_code": 65, "timestamp": 1.0}],
            "mouse_data": [{"type": "click", "x": 1, "y": 1, "button": "left", "timestamp": 1.0}]}
    parsed, _ = payloads.accept(spark.createDataFrame([(json.dumps(body),)], "raw string"))
    assert payloads.explode_events(parsed).select("pos").distinct().count() == 2


def test_iso_times_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        at = F.timestamp_micros(F.lit(1704067200000000))
        assert spark.range(1).select(iso_timestamp(at)).first()[0] == "2024-01-01T00:00:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_versions_with_free_names(spark):
    root = new_path(spark, "store")
    for name, at in (("v1", "2024-01-01T00:00:00"), ("20240301_000000", "2024-03-01T00:00:00")):
        feature_store.write_version(spark.createDataFrame([(name,)], "x string"), root, name, at)
    assert feature_store.read_latest(spark, root).first().x == "20240301_000000"
    kept = feature_store.retention(feature_store.versions(spark, root), "2025-01-01 00:00:00")
    assert {r.version: r.keep for r in kept.collect()} == {"v1": True, "20240301_000000": False}


def test_a_lagging_table_delays_its_sessions(spark, tmp_path):
    inbox, out, state = (new_path(spark, x) for x in ("inbox", "out", "state"))
    schema = "session_id string, session_start timestamp, last_event timestamp, events long"
    spark.sql("select 'a' as session_id, timestamp'2024-01-01 00:00:00' as session_start, "
              "timestamp'2024-01-01 00:00:02' as last_event, 3L as events").write.parquet(inbox)
    rows = spark.sql("select 'a' as session_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) as event_time, "
                     "date'2024-01-01' as event_date, id from range(3)")
    held = [rows.where("id < 2")]

    def run():
        closed = spark.readStream.schema(schema).parquet(inbox)
        return features_of_closed(closed, lambda: held[0], lambda m: m.groupBy("session_id").agg(F.count("*").alias("n")), out, state)

    run().awaitTermination()
    assert spark.read.parquet(out).collect() == []
    held[0] = rows
    spark.sql("select 'b' as session_id, timestamp'2024-01-01 00:00:00' as session_start, "
              "timestamp'2024-01-01 00:00:02' as last_event, 0L as events").write.mode("append").parquet(inbox)
    run().awaitTermination()
    assert [(r.session_id, r.n) for r in spark.read.parquet(out).collect()] == [("a", 3)]
