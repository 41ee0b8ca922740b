"""Hourly activity features kept up to date from the touched days only.

The state has one row for each session and hour: mergeable moments, a KLL sketch of typing gaps, a distinct sketch of
click positions, the small sets and the counts. It is partitioned by day. Gaps and movements are pairs of events, and a pair
may span midnight, so each session's first and last event of a day and lane are kept as well: pairs across days are
made from those few rows when the state is read. A day's state so depends on that day's events alone, and late
events rebuild their days by a dynamic partition overwrite.

A refresh that dies is run again; it changes nothing but its days. Means and deviations merge as Chan, Golub and LeVeque
do. Quantiles and distinct positions are exact while the sketches hold all values, and estimates of a proven error after that.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystride.operators.timings import interactions, timed_rows

MOMENTS = {"gap": "time_between_keystrokes", "speed": "mouse_velocity", "angle": "mouse_movement_angle"}
KLL_K = 400
HLL_LG_K = 14
DAY = "event_date"


def touched_days(events: DataFrame) -> list[date]:
    """Days that the events fall on; one value for each day reaches the driver."""
    return sorted(r[0] for r in events.select(F.to_date("event_time")).distinct().collect() if r[0] is not None)


def _partials(rows: DataFrame, *by: str) -> DataFrame:
    """Mergeable state of interaction rows; rows marked `pair_only` bring their timings and nothing else."""
    hour = F.hour("timestamp")
    whole = ~F.col("pair_only")
    moments = [
        a for name, c in MOMENTS.items() for a in (
            F.count(c).alias(f"{name}_n"), F.avg(c).alias(f"{name}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{name}_spread")
        )
    ]
    return rows.groupBy("session_id", F.window("timestamp", "1 hour")["start"].alias("hour"), *by).agg(
        *moments,
        F.kll_sketch_agg_double("time_between_keystrokes", KLL_K).alias("gaps"),
        F.hll_sketch_agg("mouse_click_position", HLL_LG_K).alias("positions"),
        F.collect_set("device_orientation").alias("orientations"),
        F.collect_set("screen_resolution").alias("resolutions"),
        F.count_if(whole).alias("total_interactions"),
        F.count_if(whole & (hour >= 0) & (hour <= 5)).alias("late_night_activity"),
    )


def _edges(events: DataFrame) -> DataFrame:
    """First and last event of each session, day and lane that makes pairs."""
    at = F.struct("t", "pos", "event_time", "x", "y")
    return events.where(F.col("lane").isin("key", "movement")).groupBy("session_id", DAY, "lane").agg(
        F.min(at).alias("first"), F.max(at).alias("last")
    )


def refresh(spark: SparkSession, events: str, root: str, days: list[date]) -> None:
    """Rebuild the state below `root` for the given days from the event table, which is partitioned by day."""
    if not days:
        return
    rows = spark.read.parquet(events).where(F.col(DAY).isin(days))
    # A session's days are apart here, so that no pair spans two of them.
    daily = rows.withColumn("session_id", F.concat_ws("@", F.date_format(DAY, "yyyyMMdd"), "session_id"))
    raw = interactions(timed_rows(daily)).withColumns({
        DAY: F.to_date(F.substring("session_id", 1, 8), "yyyyMMdd"), "session_id": F.expr("substring(session_id, 10)"), "pair_only": F.lit(False)
    })
    for name, table in (("hours", _partials(raw, DAY)), ("edges", _edges(rows))):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{root}/{name}")


def _pairs_across_days(edges: DataFrame) -> DataFrame:
    before = Window.partitionBy("session_id", "lane").orderBy(DAY)
    pairs = edges.withColumn("prior", F.lag("last").over(before)).where("prior is not null")
    dt, dx, dy = (F.col(f"first.{c}") - F.col(f"prior.{c}") for c in ("t", "x", "y"))
    key, move = F.col("lane") == "key", F.col("lane") == "movement"
    return pairs.select(
        "session_id", F.col("first.event_time").alias("timestamp"),
        F.when(key, dt).alias("time_between_keystrokes"),
        F.when(move & (dt > 0), F.sqrt(dx * dx + dy * dy) / dt).alias("mouse_velocity"),
        F.when(move, F.atan2(dy, dx)).alias("mouse_movement_angle"),
        *[F.lit(None).cast("string").alias(c) for c in ("mouse_click_position", "device_orientation", "screen_resolution")],
        F.lit(True).alias("pair_only"),
    )


def _merged(name: str) -> Column:
    """Moments of all parts together; a group has one part an hour and lane, so its list is short."""
    parts = F.collect_list(F.when(F.col(f"{name}_n") > 0, F.struct(
        F.col(f"{name}_n").alias("n"), F.col(f"{name}_mean").alias("mean"), F.col(f"{name}_spread").alias("spread")
    )))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("spread"))

    def join(a: Column, b: Column) -> Column:
        n, step = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"), (a["spread"] + b["spread"] + step * step * a["n"] * b["n"] / n).alias("spread")
        )

    return F.aggregate(parts, nothing, join).alias(name)


def features_from_state(spark: SparkSession, root: str, by: tuple[str, ...] = ("session_id", "hour")) -> DataFrame:
    """The activity features of each group of `by`: sessions and hours, or whole sessions."""
    hours = spark.read.parquet(f"{root}/hours").drop(DAY)
    crossing = _partials(_pairs_across_days(spark.read.parquet(f"{root}/edges")))
    merged = hours.unionByName(crossing).groupBy(*by).agg(
        *[_merged(name) for name in MOMENTS],
        F.kll_merge_agg_double("gaps", KLL_K).alias("gaps"), F.hll_union_agg("positions").alias("positions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("orientations")))).alias("device_orientation_changes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("resolutions")))).alias("screen_resolution_changes"),
        F.sum("total_interactions").alias("total_interactions"), F.sum("late_night_activity").alias("late_night_activity"),
    )

    def mean(name: str) -> Column:
        return F.when(F.col(f"{name}.n") > 0, F.col(f"{name}.mean"))

    def deviation(name: str) -> Column:
        return F.when(F.col(f"{name}.n") > 1, F.sqrt(F.col(f"{name}.spread") / (F.col(f"{name}.n") - 1)))

    return merged.select(
        *by, mean("gap").alias("avg_typing_speed"), deviation("gap").alias("typing_rhythm_consistency"),
        F.when(F.col("gap.n") > 0, F.kll_sketch_get_quantile_double("gaps", F.lit(0.9))).alias("typing_burst_speed"),
        mean("speed").alias("avg_mouse_speed"), deviation("angle").alias("mouse_direction_entropy"),
        "device_orientation_changes", "screen_resolution_changes", "total_interactions", "late_night_activity",
        F.hll_sketch_estimate("positions").alias("distinct_click_positions"),
    )
