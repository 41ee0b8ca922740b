"""Features from the stream's state against the batch operators: restarts, replays and late rows."""

import random

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from keystride import schema as S
from keystride import session
from keystride.operators.sessions import gap_sessions
from keystride.oracles import ORACLES
from keystride.plans.session_features import keystroke_features, mouse_features
from keystride.queries import QUERIES
from keystride.session import new_path
from keystride.streaming import ingest, stateful

GAP = 30


def random_events(seed, sessions=4, n=60):
    """Rows of every lane, with ties in time, repeated keydowns, unknown codes and gaps over the limit."""
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        at = 0.0
        for pos in range(n):
            at += rng.choice([0, 0.25, 0.5, 1.0, 2.0, 3.0, GAP, GAP + 5])
            kind = rng.choice(["keydown", "keydown", "keyup", "movement", "movement", "click", "scroll"])
            key = kind.startswith("key")
            rows.append((
                f"s{s}", pos, at, "key" if key else kind, kind, rng.choice([65, 66, None]) if key else None,
                None if key or rng.random() < 0.05 else float(rng.randrange(50)), None if key else float(rng.randrange(50)),
            ))
    return rows


def frame(spark, rows):
    found = spark.createDataFrame(
        rows, "session_id string, pos long, t double, lane string, kind string, key_code int, x double, y double"
    )
    return found.withColumn("event_time", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withColumns(
        {"button": F.lit(None).cast("string"), "screen_resolution": F.lit("1x1")}
    )


def batch(spark, rows, until):
    events = frame(spark, rows)
    spans = gap_sessions(events, "session_id", "event_time", GAP).where(F.unix_micros("last_event") + GAP * 1_000_000 <= until * 1_000_000)
    members = events.alias("e").join(spans.alias("s"), (F.col("e.session_id") == F.col("s.session_id")) & F.col("e.event_time").between(
        F.col("s.session_start"), F.col("s.last_event"))).select("e.*", F.unix_micros("s.session_start").alias("start")).withColumn(
        "session_id", F.concat_ws("@", "session_id", "start"))
    keys, mouse = (
        {r.session_id: [r[n] for n in names] for r in made(members).collect()}
        for made, names in ((keystroke_features, S.KEYSTROKE_FEATURES), (mouse_features, S.MOUSE_FEATURES))
    )
    return sorted(
        (r.session_id, r.start, r.events, rounded(keys.get(f"{r.session_id}@{r.start}", [None] * 5) + mouse.get(f"{r.session_id}@{r.start}", [None] * 6)))
        for r in spans.select("session_id", F.unix_micros("session_start").alias("start"), "events").collect()
    )


def rounded(values):
    return tuple(None if v is None else round(v, 8) + 0.0 for v in values)


def streamed(spark, path, out, checkpoint, delay="5 seconds"):
    shape = frame(spark, []).schema
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    found = stateful.session_state_features(rows, GAP, delay)
    ingest.start(found.writeStream.format("parquet").option("path", out), checkpoint).awaitTermination()
    return sorted(
        (r.session_id, r.start, r.events, rounded([r[n] for n in stateful.FEATURES]))
        for r in spark.read.schema(stateful.CLOSED).parquet(out).withColumn("start", F.unix_micros("session_start")).collect()
    )


def test_restarted_stream_equals_batch_and_leaves_late_rows_out(spark):
    rows = random_events(4)
    # Files by time, each shuffled, so that rows of one delay come out of order.
    rng, path, out, checkpoint = random.Random(1), new_path(spark, "in"), new_path(spark, "o"), new_path(spark, "c")
    ends = [0, 150, 153, 400, 10_000]
    parts = [[r for r in rows if lo <= r[2] < hi] for lo, hi in zip(ends, ends[1:])]
    for part in parts[:2]:
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    first = streamed(spark, path, out, checkpoint)
    assert first == streamed(spark, path, out, checkpoint)
    assert first == [r for r in batch(spark, rows, max(r[2] for p in parts[:2] for r in p) - 5) if r[0] != "late"]
    late = [("s0", 1000, 1.0, "key", "keydown", 65, None, None), ("late", 0, 2.0, "click", "click", None, 1.0, 1.0)]
    frame(spark, parts[2] + late).coalesce(1).write.mode("append").parquet(path)
    frame(spark, parts[3] + [("z", 0, 20_000.0, "click", "click", None, 1.0, 1.0)]).coalesce(1).write.mode("append").parquet(path)
    got = streamed(spark, path, out, checkpoint)
    assert got == batch(spark, rows, 20_000 - 5) and len(got) > 20
    assert {r[0] for r in got} == {"s0", "s1", "s2", "s3"}


def test_state_does_not_grow_with_the_session():
    run, held = stateful._Run(), {}
    for i in range(5000):
        run.fold((i, i / 10, i, "key", "keydown", 65, None, None), held)
    assert held == {65: (5000, pytest.approx(249.95), pytest.approx(5000 * (5000**2 - 1) / 1200))}
    run.fold((5000, 500.0, 5000, "key", "keyup", 65, None, None), held)
    assert held == {} and run.features()[0] == pytest.approx(250.05)


def test_session_without_keys_or_moves(spark):
    rows = [("a", 0, 1.0, "click", "click", None, 1.0, 1.0), ("b", 0, 1.0, "key", "keyup", 65, None, None), ("z", 0, 900.0, "scroll", "scroll", None, None, None)]
    path = new_path(spark, "in")
    frame(spark, rows + [(None, 0, 1.0, "click", "click", None, 1.0, 1.0)]).coalesce(1).write.parquet(path)
    got = streamed(spark, path, new_path(spark, "o"), new_path(spark, "c"))
    assert got == [("a", 1_000_000, 1, (None,) * 11), ("b", 1_000_000, 1, (None,) * 11)]


@pytest.fixture
def plain(spark):
    """The session as others build it: stream state on the heap, which cannot hold a stateful processor's variables."""
    before = spark.conf.get(session.PROVIDER)
    spark.conf.set(session.PROVIDER, before.replace("RocksDB", "HDFSBacked"))
    yield spark
    spark.conf.set(session.PROVIDER, before)


def test_state_query_needs_no_setting_of_the_session(plain, sf):
    assert compare(QUERIES["stream_state_features"](plain, sf), connect(sf), ORACLES["stream_state_features"]) > 0
    assert "HDFSBacked" in plain.conf.get(session.PROVIDER)


def test_scoring_query_needs_no_setting_of_the_session(plain, sf):
    assert compare(QUERIES["stream_scoring"](plain, sf), connect(sf), ORACLES["stream_scoring"]) > 0
