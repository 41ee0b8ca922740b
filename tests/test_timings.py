"""Event timings: hand-made edges, an independent loop, and sessions cut into slices."""

import math
import random

import pytest
from events import click, key, move, table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keystride.operators import slicing
from keystride.operators.timings import interactions, timed_rows
from keystride.plans.session_features import keystroke_features, mouse_features

MEASURES = ["hold", "interkey", "key_gap", "velocity", "angle", "acceleration"]


def measured(rows, **options):
    return {
        (r["session_id"], r["pos"]): {m: r[m] for m in MEASURES}
        for r in timed_rows(rows, **options).collect()
    }


def by_hand(rows):
    """The definitions, one session and one row at a time."""
    out = {}
    for session in {r.session for r in rows}:
        mine = sorted((r for r in rows if r.session == session), key=lambda r: (r.t, r.pos))
        for lane in ("key", "movement", "click"):
            events = [r for r in mine if r.lane == lane]
            valid = None
            for i, e in enumerate(events):
                m = dict.fromkeys(MEASURES)
                prior = events[i - 1] if i else None
                if lane == "key":
                    if prior:
                        m["key_gap"] = e.t - prior.t
                        if e.kind == "keydown" and m["key_gap"] < 2.0:
                            m["interkey"] = m["key_gap"]
                    if e.kind == "keydown":
                        ups = [x for x in events[i + 1:] if x.kind == "keyup" and x.code == e.code]
                        m["hold"] = ups[0].t - e.t if ups else None
                if lane == "movement" and prior:
                    dx, dy, dt = e.x - prior.x, e.y - prior.y, e.t - prior.t
                    m["angle"] = math.atan2(dy, dx)
                    if dt > 0:
                        m["velocity"] = math.sqrt(dx * dx + dy * dy) / dt
                        if valid is not None:
                            m["acceleration"] = (m["velocity"] - valid) / dt
                        valid = m["velocity"]
                out[session, e.pos] = m
    return out


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for place, values in expected.items():
        for name, value in values.items():
            if value is None:
                assert found[place][name] is None, (place, name, found[place])
            else:
                assert found[place][name] == pytest.approx(value, rel=1e-12), (place, name)


def random_rows(seed, sessions=4, length=60):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for pos in range(length * (8 if s == 0 else 1)):
            # Few distinct times, so that ties and zero distances occur.
            t = rng.randrange(0, length) / 4
            lane = rng.choice(["key", "key", "move", "move", "click"])
            if lane == "key":
                rows.append(key(f"s{s}", pos, t, rng.choice(["keydown", "keyup"]),
                                rng.choice([65, 66, 67])))
            elif lane == "move":
                rows.append(move(f"s{s}", pos, t, rng.randrange(9), rng.randrange(9)))
            else:
                rows.append(click(f"s{s}", pos, t, rng.randrange(9), rng.randrange(9)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_the_loop(spark, seed):
    rows = random_rows(seed)
    assert_same(measured(table(spark, rows)), by_hand(rows))


@pytest.mark.parametrize("limit", [1, 7, 70])
def test_sliced_sessions_equal_the_loop(spark, limit):
    rows = random_rows(11)
    assert_same(measured(table(spark, rows), max_rows=limit), by_hand(rows))


def test_one_time_for_every_event_is_still_sliced(spark):
    rows = [key("bot", i, 1.0, "keydown" if i % 3 else "keyup", 65) for i in range(200)]
    rows += [key("me", 0, 0.0, "keydown"), key("me", 1, 0.5, "keyup")]
    assert_same(measured(table(spark, rows), max_rows=20), by_hand(rows))


def test_large_sessions_really_take_the_sliced_path(spark, monkeypatch):
    seen = []
    original = slicing.materialise
    monkeypatch.setattr(
        slicing, "materialise", lambda df, label: seen.append(label) or original(df, label)
    )
    timed_rows(table(spark, random_rows(5)), max_rows=100).collect()
    assert seen == ["large-groups", "sliced"]
    seen.clear()
    timed_rows(table(spark, random_rows(5)), max_rows=10_000).collect()
    assert seen == []


def test_slices_are_bounded(spark):
    rows = table(spark, random_rows(2, sessions=1, length=100))
    sizes = []

    def step(part):
        if slicing.SLICE in part.columns:
            sizes.extend(r["count"] for r in part.groupBy(slicing.SLICE).count().collect())
        return part

    assert slicing.per_group(rows, step, max_rows=100).count() == 800
    assert len(sizes) >= 6 and max(sizes) <= 200


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(
    st.tuples(st.integers(0, 6), st.sampled_from(["keydown", "keyup"]), st.integers(65, 66)),
    min_size=1, max_size=25,
))
def test_any_key_sequence(spark, data):
    rows = [key("s", i, t / 2, kind, code) for i, (t, kind, code) in enumerate(data)]
    assert_same(measured(table(spark, rows)), by_hand(rows))
    assert_same(measured(table(spark, rows), max_rows=3), by_hand(rows))


def test_hand_made_sessions(spark):
    rows = table(spark, [
        key("tie", 2, 1.0, "keyup"), key("tie", 1, 1.0, "keydown"),
        key("repeat", 1, 0.0, "keydown"), key("repeat", 2, 0.5, "keydown"),
        key("repeat", 3, 0.8, "keyup"),
        key("no_keyup", 1, 0.0, "keydown"), key("no_keyup", 2, 1.0, "keydown"),
        key("pause", 1, 0.0, "keyup"), key("pause", 2, 2.0, "keydown"),
        key("up_down", 1, 1.0, "keyup"), key("up_down", 2, 1.2, "keydown"),
        key("one_key", 1, 3.0, "keydown"),
    ])
    found = measured(rows)
    assert found["tie", 1]["hold"] == 0.0
    assert found["repeat", 1]["hold"] == pytest.approx(0.8)
    assert found["repeat", 2]["hold"] == pytest.approx(0.3)
    assert found["no_keyup", 1]["hold"] is None
    assert found["pause", 2]["interkey"] is None and found["pause", 2]["key_gap"] == 2.0
    assert found["up_down", 2]["interkey"] == pytest.approx(0.2)
    features = {r["session_id"]: r for r in keystroke_features(rows).collect()}
    assert features["one_key"]["typing_speed"] is None
    assert features["repeat"]["typing_speed"] == pytest.approx(3 / 0.8)


def test_mouse_edges(spark):
    rows = table(spark, [
        move("zero_dt", 0, 0, 0), move("zero_dt", 1, 0, 5), move("zero_dt", 2, 1, 6),
        move("zero_dt", 3, 2, 9),
        move("one_move", 0, 0), *[click("one_move", i, i) for i in (1, 2, 3)],
        move("no_click", 0, 0, 0), move("no_click", 1, 1, 3, 4),
    ])
    found = measured(rows)
    assert [found["zero_dt", i]["velocity"] for i in range(4)] == [None, None, 1.0, 3.0]
    assert [found["zero_dt", i]["acceleration"] for i in range(4)] == [None, None, None, 2.0]
    features = {r["session_id"]: r.asDict() for r in mouse_features(rows).collect()}
    assert set(features["one_move"].values()) == {"one_move", None}
    assert features["no_click"]["click_frequency"] == 0.0
    assert features["no_click"]["mean_velocity"] == 5.0
    assert features["no_click"]["mean_acceleration"] == 0.0


def test_sessions_without_id_are_left_out(spark):
    rows = table(spark, [key(None, 1, 0.0, "keydown"), key("a", 1, 0.0, "keydown")])
    assert set(measured(rows)) == {("a", 1)}


def test_orientation_follows_the_resolution(spark):
    from pyspark.sql import functions as F

    rows = table(spark, [click("a", i, i, 1, 2) for i in range(4)]).withColumn(
        "screen_resolution",
        F.element_at(F.array(*map(F.lit, ["390x844", "800x600", "500x500", "abc"])),
                     F.col("pos").cast("int") + 1),
    )
    found = {r["pos"]: r for r in interactions(timed_rows(rows)).collect()}
    assert [found[i]["device_orientation"] for i in range(4)] == [
        "portrait", "landscape", "landscape", None
    ]
    assert found[0]["mouse_click_position"] == "1.0,2.0"
