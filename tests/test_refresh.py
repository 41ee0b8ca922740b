"""The hourly state against a full computation, after late events and repeated refreshes."""

import random
from pathlib import Path

import pytest
from events import click, key, move, table
from pyspark.sql import functions as F

from keystride.operators.timings import interactions, timed_rows
from keystride.plans import refresh
from keystride.plans.session_features import activity_features
from keystride.session import new_path

HOUR, DAY = 3600, 86_400


def random_rows(seed=1):
    rng, rows = random.Random(seed), []
    for s in ("a", "b@c"):
        for pos in range(120):
            at = rng.randrange(5) * DAY + rng.randrange(3) * HOUR + rng.randrange(40) * 60
            rows.append(rng.choice([key(s, pos, at, "keydown"), key(s, pos, at, "keyup"), move(s, pos, at, pos % 7, pos % 3), click(s, pos, at, pos % 2, 1)]))
    return rows


def plain(df, by):
    order = sorted(c for c in df.columns if c not in by)
    return {
        tuple(r[c] for c in by): tuple(pytest.approx(r[c], abs=1e-9) if isinstance(r[c], float) else r[c] for c in order) for r in df.collect()
    }


def check(spark, events, root):
    raw = interactions(timed_rows(events))
    hourly = raw.withColumn("hour", F.window("timestamp", "1 hour")["start"])
    for by, want in ((("session_id", "hour"), hourly), (("session_id",), raw)):
        assert plain(refresh.features_from_state(spark, root, by), by) == plain(activity_features(want, by), by)


def files(root):
    return {p.parent.name + "/" + p.parents[1].name: p.name for p in Path(root.removeprefix("file:")).rglob("*.parquet")}


def test_late_events_rebuild_their_days_only(spark):
    events = table(spark, random_rows()).withColumn(refresh.DAY, F.to_date("event_time"))
    late = (F.col("pos") % 4 == 1) & (F.to_date("event_time") == F.lit("1970-01-03").cast("date"))
    path, root = new_path(spark, "events"), new_path(spark, "state")
    events.where(~late).coalesce(1).write.partitionBy(refresh.DAY).parquet(path)
    refresh.refresh(spark, path, root, refresh.touched_days(events.where(~late)))
    check(spark, events.where(~late), root)
    before = files(root)

    events.where(late).coalesce(1).write.mode("append").partitionBy(refresh.DAY).parquet(path)
    days = refresh.touched_days(events.where(late))
    assert [str(d) for d in days] == ["1970-01-03"]
    refresh.refresh(spark, path, root, days)
    check(spark, events, root)
    after = files(root)
    assert {k for k in after if after[k] != before.get(k)} == {k for k in after if "1970-01-03" in k}
    # A refresh that is run again, or for nothing, changes nothing.
    refresh.refresh(spark, path, root, days)
    refresh.refresh(spark, path, root, [])
    check(spark, events, root)


def test_only_touched_days_are_read(spark, monkeypatch):
    events = table(spark, random_rows()).withColumn(refresh.DAY, F.to_date("event_time"))
    path, seen = new_path(spark, "events"), []
    events.write.partitionBy(refresh.DAY).parquet(path)
    monkeypatch.setattr(refresh, "interactions", lambda timed: seen.append(timed) or interactions(timed))
    refresh.refresh(spark, path, new_path(spark, "state"), refresh.touched_days(events)[1:2])
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan or "PartitionFilters: [(event_date" in plan or "PartitionFilters: [event_date" in plan
    days = {r[0] for r in seen[0].select(F.substring("session_id", 1, 8)).distinct().collect()}
    assert days == {"19700102"}
