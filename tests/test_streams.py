"""Streams against their batch twins, restarts and replays."""

import json

import pytest
from events import key, table
from pyspark.sql import functions as F

from keystride.operators.sessions import gap_sessions
from keystride.session import new_path
from keystride.sources import payloads
from keystride.streaming import ingest, sessions


def write(path, name, *lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(
        x if isinstance(x, str) else json.dumps(x) for x in lines
    ) + "\n")


def payload(at, *times, session="a"):
    return {"session_id": session, "timestamp": at, "session_duration": 1.0,
            "keystroke_data": [{"event_type": "keydown", "key_code": 65, "timestamp": t}
                               for t in times],
            "mouse_data": [], "device_info": None}


def test_restart_continues_and_keeps_resends_out(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", new_path(spark, "o"), new_path(spark, "c")

    def run():
        texts = ingest.text_stream(spark, str(inbox))
        events = ingest.distinct_events(ingest.accepted_events(texts), "1 hour")
        ingest.store_events(events, out, checkpoint).awaitTermination()
        return sorted(r["t"] for r in spark.read.parquet(out).collect())

    first = payload("2024-01-01T00:00:00Z", 10.0, 11.0)
    write(inbox, "1.json", first, "not json", '{"session_id": "a"}')
    assert run() == [10.0, 11.0]
    assert run() == [10.0, 11.0]
    write(inbox, "2.json", payload("2024-01-01T00:00:05Z", 10.0, 11.0, 12.0))
    assert run() == [10.0, 11.0, 12.0]


def test_payload_stream_keeps_broken_lines(spark, tmp_path):
    inbox, out = tmp_path / "in", new_path(spark, "o")
    write(inbox, "1.json", payload("2024-01-01T00:00:00Z", 1.0), "not json")
    rows = ingest.payload_stream(spark, str(inbox))
    ingest.start(
        rows.writeStream.format("parquet").option("path", out), new_path(spark, "c")
    ).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 2
    assert found.filter(F.col(payloads.CORRUPT).isNotNull()).count() == 1


def test_rejected_bodies_are_kept_as_they_came(spark, tmp_path):
    inbox, out = tmp_path / "in", new_path(spark, "o")
    bodies = ["not json", '{"session_id": "a"}']
    write(inbox, "1.json", payload("2024-01-01T00:00:00Z", 1.0), *bodies)
    texts = ingest.text_stream(spark, str(inbox))
    ingest.store_rejected(texts, out, new_path(spark, "c")).awaitTermination()
    assert sorted(r["raw"] for r in spark.read.parquet(out).collect()) == sorted(bodies)


def stream_of(spark, rows):
    path = new_path(spark, "rows")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@pytest.fixture
def visits(spark):
    """Session a: 0-20 s and 100-110 s; a gap of exactly 30 s inside; b keeps the clock going."""
    rows = [key("a", i, t, "keydown") for i, t in enumerate((0, 20, 50, 100, 110))]
    return table(spark, rows + [key("b", 0, 9000, "keydown"), key("b", 1, 9001, "keyup")])


def test_gap_sessions_equal_session_windows(spark, visits):
    found = gap_sessions(visits, "session_id", "event_time", 30)
    window = visits.groupBy("session_id", F.session_window("event_time", "30 seconds")).agg(
        F.min("event_time").alias("session_start"), F.max("event_time").alias("last_event"),
        F.count("*").alias("events"),
    ).drop("session_window")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, window.collect()))


def test_closed_sessions_leave_the_open_one_out(spark, visits):
    out = new_path(spark, "o")
    closed = sessions.closed_sessions(stream_of(spark, visits), "30 seconds", "1 second")
    ingest.start(
        closed.writeStream.format("parquet").option("path", out), new_path(spark, "c")
    ).awaitTermination()
    found = {(r["session_id"], r["events"]) for r in spark.read.parquet(out).collect()}
    batch = {(r["session_id"], r["events"])
             for r in gap_sessions(visits, "session_id", "event_time", 30).collect()}
    assert found == {x for x in batch if x[0] != "b"}


def test_features_of_closed_sessions_equal_batch(spark, visits):
    from keystride.plans.session_features import keystroke_features

    out = new_path(spark, "o")
    closed = sessions.closed_sessions(stream_of(spark, visits), "31 seconds", "1 second")
    dated = visits.withColumn("event_date", F.to_date("event_time")).withColumn(
        "session_id", F.concat("session_id", F.lit("@x@1")))
    closed = closed.withColumn("session_id", F.concat("session_id", F.lit("@x@1")))
    sessions.features_of_closed(
        closed, lambda: dated, keystroke_features, out, new_path(spark, "c")
    ).awaitTermination()
    found = {(r["session_id"], r["session_start"].second, round(r["typing_speed"], 9))
             for r in spark.read.parquet(out).collect()}
    assert found == {("a@x@1", 0, round(3 / 50, 9)), ("a@x@1", 40, round(2 / 10, 9))}


def test_scoring_replaces_a_replayed_batch(spark, visits):
    out = new_path(spark, "o")
    for _ in range(2):
        sessions.score_stream(
            stream_of(spark, visits), lambda b: b.select("session_id", "pos"), out,
            new_path(spark, "c"),
        ).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def test_running_on_the_flush_interval(spark, tmp_path):
    inbox, out = tmp_path / "in", new_path(spark, "o")
    write(inbox, "1.json", payload("2024-01-01T00:00:00Z", 1.0))
    events = ingest.accepted_events(ingest.text_stream(spark, str(inbox)))
    running = ingest.store_events(events, out, new_path(spark, "c"), continuous=True)
    try:
        running.processAllAvailable()
        write(inbox, "2.json", payload("2024-01-01T00:00:05Z", 2.0))
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(r["t"] for r in spark.read.parquet(out).collect()) == [1.0, 2.0]
