"""Timing and movement quantities of every event, relative to its neighbours."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.functions.scalars import screen_size
from keystride.operators.slicing import SLICE, nearest, per_group


def timed_rows(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Event rows plus key_gap, interkey, hold, velocity, angle, acceleration.

    One exchange on the session serves every window here and a later aggregate or join on
    session_id; windows whose column is not read are pruned.
    """
    return per_group(events, _timings, max_rows=max_rows)


def _timings(events: DataFrame) -> DataFrame:
    events = events.repartition(*[c for c in ("session_id", SLICE) if c in events.columns])
    lane = ["session_id", "lane"]
    is_key = F.col("lane") == "key"
    is_move = F.col("lane") == "movement"

    rows = nearest(events, "prior", F.struct("t", "x", "y"), lane)
    dt = F.col("t") - F.col("prior.t")
    dx = F.col("x") - F.col("prior.x")
    dy = F.col("y") - F.col("prior.y")
    rows = rows.select(
        "*",
        F.when(is_key, dt).alias("key_gap"),
        F.when(is_key & (F.col("kind") == "keydown") & (dt < S.LONG_PAUSE_SECONDS), dt)
        .alias("interkey"),
        F.when(is_move & (dt > 0), F.sqrt(dx * dx + dy * dy) / dt).alias("velocity"),
        F.when(is_move & F.col("prior").isNotNull(), F.atan2(dy, dx)).alias("angle"),
        dt.alias("dt"),
    ).drop("prior")

    # Pairs without a velocity are skipped: the closest earlier *valid* velocity counts.
    rows = nearest(rows, "prior_velocity", F.col("velocity"), lane)
    rows = rows.withColumn(
        "acceleration",
        F.when(F.col("velocity").isNotNull(),
               (F.col("velocity") - F.col("prior_velocity")) / F.col("dt")),
    ).drop("prior_velocity")

    # A keyup is not used up: repeated keydowns of one code share the keyup that follows.
    released = F.when(F.col("kind") == "keyup", F.col("t"))
    rows = nearest(rows, "released", released, [*lane, "key_code"], after=True)
    return rows.withColumn(
        "hold", F.when(F.col("kind") == "keydown", F.col("released") - F.col("t"))
    ).drop("released")


def click_position() -> Column:
    place = F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"))
    return F.when(F.col("lane") == "click", place)


def interactions(timed: DataFrame) -> DataFrame:
    """Timed rows in the column layout the activity aggregate reads, one per event."""
    width, height = screen_size(F.col("screen_resolution"))
    return timed.select(
        "session_id",
        "pos",
        F.col("event_time").alias("timestamp"),
        F.col("key_gap").alias("time_between_keystrokes"),
        F.col("velocity").alias("mouse_velocity"),
        F.col("angle").alias("mouse_movement_angle"),
        click_position().alias("mouse_click_position"),
        F.when(height > width, "portrait").when(height <= width, "landscape")
        .alias("device_orientation"),
        "screen_resolution",
    )
