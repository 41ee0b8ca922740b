"""Session features, device rules, alignment, activity and scoring edges."""

from datetime import datetime

import pytest
from events import key, move, table
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.functions import scalars
from keystride.plans import scoring
from keystride.plans.feature_build import process_raw, register_raw
from keystride.plans.session_features import (
    activity_features, align, device_features, session_features,
)
from keystride.session import new_path
from keystride.sources import feature_store

SESSIONS = """session_id string, session_duration double, device_info struct<
screen_resolution: string, browser_language: string, timezone_offset: int, platform: string,
is_mobile: boolean>"""


def records(spark, rows):
    return spark.createDataFrame(rows, SESSIONS)


def device(resolution, mobile=True, offset=-240):
    return (resolution, "en-US", offset, "x", mobile)


def test_device_rules(spark):
    rows = records(spark, [
        ("ok", 1.0, device("1920x1080", False)),
        ("no_resolution", 1.0, device(None)),
        ("bad", 1.0, device("abc")),
        ("three", 1.0, device("1x2x3")),
        ("zero", 1.0, device("10x0")),
        ("bare", 1.0, device("100x50", None, None)),
        ("no_device", 1.0, None),
    ])
    found = {r[0]: tuple(r)[1:] for r in device_features(rows).collect()}
    assert found["ok"] == (1920.0, 1080.0, 1920 / 1080, 0.0, -240.0)
    assert found["no_resolution"] == found["no_device"] == (0.0,) * 5
    assert found["bad"] == found["three"] == (None, None, None, 1.0, -240.0)
    assert found["zero"] == (10.0, 0.0, None, 1.0, -240.0)
    assert found["bare"] == (100.0, 50.0, 2.0, 0.0, 0.0)


def test_a_family_a_session_lacks_stays_null_and_aligns_to_zero(spark):
    events = table(spark, [key("keys", 0, 0, "keydown"), key("keys", 1, 1, "keyup"),
                           move("mouse", 0, 0), move("mouse", 1, 1, 3, 4)])
    sessions = records(spark, [("keys", 9.0, device("10x5")), ("idle", None, device("10x5"))])
    features = session_features(events, sessions)
    assert features.columns == ["session_id", *S.SESSION_FEATURES]
    found = {r["session_id"]: r for r in features.collect()}
    assert found["keys"]["keystroke_mean_hold_time"] == 1.0
    assert found["keys"]["mouse_mean_velocity"] is None
    assert found["mouse"]["mouse_mean_velocity"] == 5.0
    assert found["mouse"]["device_screen_width"] is None
    assert found["idle"]["session_duration"] == 0.0
    aligned = align(features, ["mouse_mean_velocity", "unknown"])
    assert aligned.columns == ["session_id", "mouse_mean_velocity", "unknown"]
    assert {tuple(r) for r in aligned.collect()} == {
        ("keys", 0.0, 0.0), ("mouse", 5.0, 0.0), ("idle", 0.0, 0.0)
    }


def raw(spark):
    def row(session, hour, gap=None, at=None, orientation="portrait", resolution="1x2"):
        return (session, datetime(2024, 1, 1, hour), gap, None, None, at, orientation, resolution)

    return spark.createDataFrame([
        row("night", 23), row("night", 0), row("night", 5), row("night", 6),
        row("single", 12, 0.5),
        row("many", 12, 1.0, "1,1"), row("many", 12, 3.0, "1,1", "landscape"),
        row("many", 12, None, "2,1", "landscape", "2x1"),
    ], S.RAW)


def test_activity_edges(spark):
    found = {r["session_id"]: r for r in activity_features(raw(spark)).collect()}
    assert found["night"]["late_night_activity"] == 2
    assert found["single"]["typing_rhythm_consistency"] is None
    assert found["many"]["typing_rhythm_consistency"] == pytest.approx(2 ** 0.5)
    assert found["many"]["distinct_click_positions"] == 2
    assert found["night"]["distinct_click_positions"] == 0
    assert found["many"]["device_orientation_changes"] == ["landscape", "portrait"]
    assert found["many"]["screen_resolution_changes"] == ["1x2", "2x1"]


def test_approximate_click_count_needs_one_pass(spark):
    exact, sketched = activity_features(raw(spark)), activity_features(raw(spark), approximate=True)
    assert sorted(exact.columns) == sorted(sketched.columns)
    assert exact.exceptAll(sketched.select(exact.columns)).isEmpty()


def test_raw_rows_can_be_queried_and_stored(spark):
    view = register_raw(raw(spark))
    assert spark.sql(f"select count(*) from {view}").first()[0] == 8
    root = new_path(spark, "store")
    built = process_raw(raw(spark), root, "20240102_030405", "now")
    assert len(built.features.columns) == 14
    assert [tuple(r) for r in feature_store.metadata(spark, root).collect()] == [
        ("20240102_030405", "now", 14, 3)
    ]
    stored = feature_store.read_latest(spark, root)
    assert stored.count() == 3 and stored.first()["version"] == "20240102_030405"


def test_tiers_are_strict(spark):
    rows = spark.createDataFrame([(x,) for x in (0.3, 0.30001, 0.7, 0.70001, None)], "r double")
    found = [r[0] for r in rows.select(scalars.risk_tier(F.col("r"))).collect()]
    assert found == ["low", "medium", "medium", "high", None]


def test_mobile_agents_and_resolution_text(spark):
    row = spark.range(1).select(
        scalars.is_mobile_agent(F.lit("x IPHONE y")).alias("a"),
        scalars.is_mobile_agent(F.lit("desktop")).alias("b"),
        scalars.resolution_text(F.lit(10), F.lit(20)).alias("c"),
        scalars.percent_text(F.lit(0.725)).alias("d"),
        scalars.session_key(F.lit("1")).alias("e"),
    ).first()
    assert tuple(row) == (True, False, "10x20", "72.5%", "6b86b273ff34fce1")


def test_contributions_sum_to_one_or_stay_zero(spark):
    rows = spark.createDataFrame([("a", 1.0, -3.0), ("b", 0.0, 0.0)], "session_id string, p double, q double")
    found = {(r[0], r[1]): r[2] for r in scoring.contribution_rows(rows, ["p", "q"]).collect()}
    assert found == {("a", "p"): 0.25, ("a", "q"): 0.75, ("b", "p"): 0.0, ("b", "q"): 0.0}


@pytest.mark.parametrize("risk, unusual", [(0.9, 3), (0.5, 1), (0.1, 0)])
def test_factors_by_tier(spark, risk, unusual):
    rows = spark.createDataFrame([("a", 5.0, 3.0, 1.0)], """session_id string,
        mouse_mean_velocity double, session_duration double, device_is_mobile double""")
    tier = scalars.risk_tier(F.lit(risk))
    found = rows.select(scoring.factor_list(rows.columns[1:], tier)).first()[0]
    names = ["mouse", "behaviour", "device"]
    assert found == [
        (scoring.UNUSUAL if i < unusual else scoring.NORMAL)[n] for i, n in enumerate(names)
    ]


def test_ensemble_without_supervised_model(spark):
    row = spark.range(1).select(
        scoring.ensemble_risk(F.lit(0.25)).alias("a"),
        scoring.ensemble_risk(F.lit(0.25), F.lit(1.0)).alias("b"),
    ).first()
    assert row["a"] == 0.75 and row["b"] == pytest.approx(0.7 * 0.75 + 0.3)
