"""Sessions by inactivity gap, and features per time window (R3 batch twin, C5)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(rows: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Runs of events no further apart than the gap: start, last event and count.

    Events in one clock cell of the gap's width always belong together, so cells are
    aggregated first, on both sides of the shuffle. What the window orders is one row per key
    and occupied cell, a number set by the time span and not by the event rate.
    """
    width = gap_seconds * 1_000_000
    cells = (
        rows.select(key, F.unix_micros(time).alias("at"))
        .groupBy(key, F.floor(F.col("at") / width).alias("cell"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"),
             F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(key).orderBy("cell")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) > width, F.lit(True))
    numbered = cells.withColumn("opens", starts.cast("int")).withColumn(
        "run", F.sum("opens").over(order)
    )
    return numbered.groupBy(key, "run").agg(
        F.timestamp_micros(F.min("first")).alias("session_start"),
        F.timestamp_micros(F.max("last")).alias("last_event"),
        F.sum("n").alias("events"),
    ).drop("run")
