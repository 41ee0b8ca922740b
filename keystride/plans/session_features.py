"""Per-session features (A1-A17, J1): the 17 model features and the activity features."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.functions.scalars import screen_size
from keystride.operators.timings import click_position, interactions, timed_rows


def _keystroke_aggregates() -> list[Column]:
    key_t = F.when(F.col("lane") == "key", F.col("t"))
    return [
        F.avg("hold").alias("mean_hold_time"),
        F.stddev_pop("hold").alias("std_hold_time"),
        F.avg("interkey").alias("mean_interkey_time"),
        F.stddev_pop("interkey").alias("std_interkey_time"),
        F.try_divide(F.count(key_t), F.max(key_t) - F.min(key_t)).alias("typing_speed"),
    ]


def _mouse_aggregates() -> list[Column]:
    """Fewer than two movements leave every mouse feature out, clicks included."""
    mouse_t = F.when(F.col("lane") != "key", F.col("t"))
    clicks = F.count_if(F.col("lane") == "click")
    enough = F.count_if(F.col("lane") == "movement") >= 2
    mean_acceleration = F.coalesce(F.avg("acceleration"), F.lit(0.0))
    values = {
        "mean_velocity": F.avg("velocity"),
        "std_velocity": F.stddev_pop("velocity"),
        "mean_acceleration": mean_acceleration,
        "std_acceleration": F.coalesce(F.stddev_pop("acceleration"), F.lit(0.0)),
        "click_frequency": F.try_divide(clicks, F.max(mouse_t) - F.min(mouse_t)),
        "movement_smoothness": mean_acceleration,
    }
    return [F.when(enough, values[name]).alias(name) for name in S.MOUSE_FEATURES]


def keystroke_features(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    keys = events.filter(F.col("lane") == "key")
    return timed_rows(keys, max_rows).groupBy("session_id").agg(*_keystroke_aggregates())


def mouse_features(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    mouse = events.filter(F.col("lane") != "key")
    return timed_rows(mouse, max_rows).groupBy("session_id").agg(*_mouse_aggregates())


def _device_columns(prefix: str = "") -> list[Column]:
    """Screen size, ratio, mobile flag and offset; all 0 when the resolution is missing.

    A resolution that does not parse leaves size and ratio NULL.
    """
    resolution = F.col("device_info.screen_resolution")
    width, height = screen_size(resolution)
    values = {
        "screen_width": width.cast("double"),
        "screen_height": height.cast("double"),
        "screen_ratio": F.try_divide(width, height),
        "is_mobile": F.coalesce(F.col("device_info.is_mobile"), F.lit(False)).cast("double"),
        "timezone_offset":
            F.coalesce(F.col("device_info.timezone_offset"), F.lit(0)).cast("double"),
    }
    return [
        F.when(resolution.isNull(), F.lit(0.0)).otherwise(values[name]).alias(prefix + name)
        for name in S.DEVICE_FEATURES
    ]


def device_features(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", *_device_columns())


def session_features(
    events: DataFrame, sessions: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """All 17 features of every session that has events or a session record.

    Key and mouse features come from one pass and one exchange; the join with the session
    records reuses that partitioning. A family a session lacks stays NULL.
    """
    named = [a.alias(f"keystroke_{n}")
             for a, n in zip(_keystroke_aggregates(), S.KEYSTROKE_FEATURES)]
    named += [a.alias(f"mouse_{n}") for a, n in zip(_mouse_aggregates(), S.MOUSE_FEATURES)]
    behaviour = timed_rows(events, max_rows).groupBy("session_id").agg(*named)
    records = sessions.select("session_id", "session_duration", *_device_columns("device_"))
    return (
        behaviour.join(records, "session_id", "full_outer")
        .withColumn("session_duration", F.coalesce("session_duration", F.lit(0.0)))
        .select("session_id", *S.SESSION_FEATURES)
    )


def align(features: DataFrame, names: list[str], keep: tuple[str, ...] = ("session_id",)):
    """The named features in model order: unknown or NULL ones become 0.0, others go."""
    present = set(features.columns)
    return features.select(
        *keep,
        *[
            F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n)
            if n in present else F.lit(0.0).alias(n)
            for n in names
        ],
    )


def activity_features(
    raw: DataFrame, by: tuple[str, ...] = ("session_id",), approximate: bool = False,
    clicks: DataFrame | None = None,
) -> DataFrame:
    """The activity aggregate over interaction rows; sample standard deviations.

    Distinct click positions are counted on their own, over click rows only: beside the
    percentile and the sets, each position would carry a digest of its own. `clicks` are the
    same click positions from rows that no window has partitioned by session yet: then a busy
    session's positions spread over all tasks before they are counted. `approximate` counts them with a
    sketch in the main pass instead.
    """
    hour = F.hour("timestamp")
    sketch = F.approx_count_distinct("mouse_click_position").alias("distinct_click_positions")
    activity = raw.groupBy(*by).agg(
        F.avg("time_between_keystrokes").alias("avg_typing_speed"),
        F.stddev_samp("time_between_keystrokes").alias("typing_rhythm_consistency"),
        F.percentile_approx("time_between_keystrokes", 0.9).alias("typing_burst_speed"),
        F.avg("mouse_velocity").alias("avg_mouse_speed"),
        F.stddev_samp("mouse_movement_angle").alias("mouse_direction_entropy"),
        F.array_sort(F.collect_set("device_orientation")).alias("device_orientation_changes"),
        F.array_sort(F.collect_set("screen_resolution")).alias("screen_resolution_changes"),
        F.count(F.lit(1)).alias("total_interactions"),
        F.count_if((hour >= 0) & (hour <= 5)).alias("late_night_activity"),
        *([sketch] if approximate else []),
    )
    if approximate:
        return activity
    clicks = raw if clicks is None else clicks
    clicks = (
        clicks.filter(F.col("mouse_click_position").isNotNull())
        .groupBy(*by)
        .agg(F.count_distinct("mouse_click_position").alias("distinct_click_positions"))
    )
    return activity.join(clicks, list(by), "left").fillna(0, "distinct_click_positions")


def session_activity(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    clicks = events.select("session_id", click_position().alias("mouse_click_position"))
    return activity_features(interactions(timed_rows(events, max_rows)), clicks=clicks)
