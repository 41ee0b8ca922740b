"""Payload files: broken lines, documents, merging, resends, positions."""

import json

import pytest
from events import click, key, move, table
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.operators.timings import timed_rows
from keystride.plans.session_features import session_features
from keystride.session import new_path
from keystride.sources import payloads

DEVICE = {"screen_resolution": "1920x1080", "browser_language": "en-US",
          "timezone_offset": -240, "platform": "MacOS", "is_mobile": False}


def payload(session="a", at="2024-01-01T00:00:00Z", duration=1.0, keys=(), mouse=()):
    return {
        "session_id": session, "timestamp": at, "session_duration": duration,
        "keystroke_data": [
            {"event_type": kind, "key_code": code, "timestamp": t} for kind, code, t in keys
        ],
        "mouse_data": list(mouse), "device_info": DEVICE,
    }


@pytest.fixture
def log(tmp_path):
    def write(*lines):
        path = tmp_path / "log"
        path.mkdir(exist_ok=True)
        text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
        (path / f"{len(list(path.iterdir()))}.json").write_text(text + "\n")
        return str(path)

    return write


def test_broken_lines_keep_their_text(spark, log):
    found = payloads.read_log(spark, log(payload(), "not json")).collect()
    assert sorted(str(r[payloads.CORRUPT]) for r in found) == ["None", "not json"]


def test_presence_is_what_validation_asks_for(spark):
    texts = {
        json.dumps(payload()): True,
        '{"session_id": null, "timestamp": null}': True,
        '{"session_id": "a"}': False,
        '{"timestamp": "x"}': False,
        '["session_id", "timestamp"]': False,
        "not json": False,
        "": False,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    assert {r["raw"]: r["is_valid"] for r in payloads.validate(rows).collect()} == texts
    accepted, rejected = payloads.accept(rows)
    assert accepted.count() == 2 and rejected.count() == 5
    assert rejected.columns == ["raw", "reason"]


def test_button_number_or_text(spark, log):
    mouse = [{"type": "click", "x": 1, "y": 2, "button": b, "timestamp": 1.0 + i}
             for i, b in enumerate([0, "left"])]
    events = payloads.explode_events(payloads.read_log(spark, log(payload(mouse=mouse))))
    assert sorted(r["button"] for r in events.collect()) == ["0", "left"]


def test_missing_and_empty_arrays_give_no_events(spark, log):
    bare = {"session_id": "b", "timestamp": "2024-01-01T00:00:00"}
    rows = payloads.read_log(spark, log(payload(), bare))
    assert payloads.explode_events(rows).count() == 0
    features = session_features(payloads.explode_events(rows), payloads.session_records(rows))
    found = {r["session_id"]: r for r in features.collect()}
    assert found["a"]["device_screen_width"] == 1920.0 and found["a"]["session_duration"] == 1.0
    assert found["b"]["device_screen_width"] == 0.0 and found["b"]["session_duration"] == 0.0


def test_equal_times_keep_arrival_order_across_payloads(spark, log):
    late = payload(at="2024-01-01T00:00:05Z", keys=[("keyup", 65, 1.0)])
    early = payload(at="2024-01-01T00:00:01Z", keys=[("keyup", 65, 1.0), ("keydown", 65, 1.0)])
    events = payloads.explode_events(payloads.read_log(spark, log(late, early)))
    holds = [r["hold"] for r in timed_rows(events).collect() if r["hold"] is not None]
    assert holds == [0.0]


def test_resent_payload_changes_nothing_after_deduplication(spark, log):
    one = payload(keys=[("keydown", 65, 1.0), ("keyup", 65, 1.5)],
                  mouse=[{"type": "movement", "x": 1, "y": 1, "timestamp": 2.0}])
    again = dict(one, timestamp="2024-01-01T00:00:09Z")
    once = payloads.explode_events(payloads.read_log(spark, log(one)))
    kept = sorted(map(str, once.collect()))
    twice = payloads.explode_events(payloads.read_log(spark, log(again)))
    assert twice.count() == 6
    assert sorted(map(str, payloads.deduplicate(twice).collect())) == kept


def test_latest_device_and_longest_duration_win(spark, log):
    old = payload(at="2024-01-01T00:00:00Z", duration=1.0)
    new = payload(at="2024-01-01T00:01:00Z", duration=61.0)
    new["device_info"] = dict(DEVICE, screen_resolution="390x844")
    none = dict(payload(), session_id=None)
    found = payloads.session_records(payloads.read_log(spark, log(new, old, none))).collect()
    assert len(found) == 1
    assert found[0]["session_duration"] == 61.0
    assert found[0]["device_info"]["screen_resolution"] == "390x844"


def documents(spark, block=payloads.BLOCK):
    """Session a has three events in the first flush interval, b has one."""
    events = table(spark, [key("a", 0, 1, "keydown"), key("a", 1, 2, "keyup"),
                           move("a", 2, 3, 1, 1), click("b", 0, 4, 2, 2)])
    sessions = events.groupBy("session_id").agg(F.min("t").alias("session_start")).withColumn(
        "device_info", F.from_json(F.lit(json.dumps(DEVICE)), """screen_resolution string,
        browser_language string, timezone_offset int, platform string, is_mobile boolean""")
    )
    return payloads.documents(events, sessions, block)


def test_one_document_per_block(spark):
    assert documents(spark).count() == 2
    small = documents(spark, block=2).collect()
    assert len(small) == 3
    assert max(len(r["keystroke_data"]) + len(r["mouse_data"]) for r in small) == 2


def test_indented_documents_round_trip(spark):
    docs = documents(spark)
    expected = sorted(map(str, payloads.explode_events(docs).collect()))
    many = new_path(spark, "docs")
    payloads.write_documents(docs, many)
    single = new_path(spark, "doc")
    payloads.write_document(docs, single)
    for read in (payloads.read_documents(spark, many), payloads.read_document(spark, single)):
        assert sorted(map(str, payloads.explode_events(read).collect())) == expected
    text = spark.read.text(single).filter(F.col("value").contains("session_id")).first()[0]
    assert text.startswith("  ")


def test_requests_need_an_id_and_data(spark):
    events = table(spark, [key("a", 0, 1, "keydown"), key("a", 1, 2, "keyup")])
    requests = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "session_id string")
    assert [r[0] for r in payloads.with_data(requests, events).collect()] == ["a"]
    assert [r[0] for r in payloads.without_data(requests, events).collect()] == ["b"]


def test_full_flushes_are_split_and_nothing_is_lost(spark):
    rows = [key("bot", i, 1.0, "keydown") for i in range(50)]
    rows += [key("me", 100 * i, i, "keydown") for i in range(8)]
    events = table(spark, rows)
    sessions = events.groupBy("session_id").agg(F.min("t").alias("session_start")).withColumn(
        "device_info", F.lit(None).cast("struct<screen_resolution: string>")
    )
    docs = payloads.documents(events, sessions, block=10).collect()
    sizes = {s: sorted(len(r["keystroke_data"]) for r in docs if r["session_id"] == s)
             for s in ("bot", "me")}
    assert sizes == {"bot": [10] * 5, "me": [3, 5]}
    assert sorted((r["session_id"], e["pos"]) for r in docs for e in r["keystroke_data"]) == \
        sorted((r.session, r.pos) for r in rows)


def test_a_resend_under_another_device_is_still_a_copy(spark, log):
    one = payload(keys=[("keydown", 65, 1.0)])
    turned = dict(one, timestamp="2024-01-01T00:00:09Z",
                  device_info=dict(DEVICE, screen_resolution="1080x1920"))
    events = payloads.explode_events(payloads.read_log(spark, log(turned, one)))
    kept = payloads.deduplicate(events).collect()
    assert [r["screen_resolution"] for r in kept] == ["1920x1080"]


def test_positions_of_payloads_without_readable_times(spark):
    rows = [
        ("a", "not a time", 1.0, [("keydown", 65, 5.0, None)], [], None), ("a", None, 1.0, [("keyup", 65, 5.0, None)], [], None),
        ("a", "2024-01-01T00:00:00Z", 1.0, [("keydown", 66, 7.0, None), ("keyup", 66, 7.0, None)], [], None),
        ("a", "2024-01-01T00:00:00Z", 1.0, [("keydown", 67, 7.0, None)], [("click", 1.0, 1.0, "0", 7.0, None)], None),
        ("a", "9999-12-31T00:00:00Z", 1.0, [("keydown", 68, 9.0, None)], None, None),
    ]
    events = payloads.explode_events(spark.createDataFrame(rows, S.PAYLOAD)).collect()
    assert len(events) == len({e["pos"] for e in events}) == 7
    by_code = {(e["key_code"], e["kind"]): e["pos"] for e in events}
    assert by_code[66, "keydown"] + 1 == by_code[66, "keyup"]


def test_refused_bodies_say_why(spark):
    texts = ["not json", "[1]", '{"session_id": "a"}', '{"session_id": "a", "timestamp": "x", "session_duration": "long"}', '{"session_id": null, "timestamp": "x"}']
    parsed, refused = payloads.accept(spark.createDataFrame([(t,) for t in texts], "raw string"))
    assert parsed.count() == 1
    assert {r["raw"]: r["reason"] for r in refused.collect()} == dict(zip(
        texts, [payloads.NO_OBJECT, payloads.NO_OBJECT, payloads.NO_FIELDS, payloads.LOSSY]
    ))
