"""Row-ordered work per group when one group may hold a large part of all rows.

A window over `session_id` puts a whole session into one task. `per_group` checks the group
sizes first. Groups that fit run through the plain window. Larger ones are cut into
consecutive slices by a range partitioning on (group, order) - ties included, because the
order is unique - and `nearest` bridges the cuts with one small row per slice.
"""

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.session import materialise

MAX_GROUP_ROWS = 1_000_000
# A group only counts as large when it also exceeds this fraction of all rows, so there are
# fewer large groups than this: the bound that makes their key list safe to broadcast.
MAX_LARGE_GROUPS = 100_000

ORDER = ["t", "pos"]
SLICE = "slice"


def per_group(
    rows: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    key: str = "session_id",
    max_rows: int | None = None,
) -> DataFrame:
    """Apply the row-level `step` (built from `nearest`) to groups of any size.

    `step` must keep one output row per input row; aggregate afterwards.
    """
    max_rows = max_rows or MAX_GROUP_ROWS
    rows = rows.filter(F.col(key).isNotNull())
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("largest")).first()
    limit = max(max_rows, (seen["total"] or 0) // MAX_LARGE_GROUPS)
    if (seen["largest"] or 0) <= limit:
        return step(rows)

    large = materialise(sizes.filter(F.col("n") > limit), "large-groups")
    keys = F.broadcast(large.select(key))
    slices = ceil(large.agg(F.sum("n")).first()[0] / limit)
    # The slice number must not change between two reads of it, hence the written table.
    sliced = materialise(
        rows.join(keys, key, "left_semi")
        .repartitionByRange(slices, key, *ORDER)
        .withColumn(SLICE, F.spark_partition_id()),
        "sliced",
    )
    small = rows.join(keys, key, "left_anti")
    return step(small).unionByName(step(sliced).drop(SLICE))


def nearest(
    rows: DataFrame, name: str, value: Column, by: list[str], after: bool = False
) -> DataFrame:
    """Add `name`: the closest non-null `value` strictly before each row of its group.

    With `after`, the closest one strictly after it. The frame only grows, so the work is
    linear after the sort. Rows cut into slices look within their slice first and take the
    rest from the slices before (after) it.
    """
    direction = F.desc if after else F.asc
    sliced = SLICE in rows.columns
    within = [*by, SLICE] if sliced else by
    frame = (
        Window.partitionBy(*within)
        .orderBy(*[direction(c) for c in ORDER])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))
    if not sliced:
        return found

    edge = F.min if after else F.max
    reachable = F.when(value.isNotNull(), F.struct(*ORDER, value.alias("value")))
    beyond = (
        Window.partitionBy(*by)
        .orderBy(direction(SLICE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = (
        rows.groupBy(*within)
        .agg(edge(reachable).alias("edge"))
        .withColumn("carried", F.last("edge", ignorenulls=True).over(beyond)["value"])
        .select(*within, "carried")
    )
    return (
        _beside(found, edges, within)
        .withColumn(name, F.coalesce(name, "carried"))
        .drop("carried")
    )


def position(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Add `name`: the place, from 0, of each row in its group."""
    sliced = SLICE in rows.columns
    within = [*by, SLICE] if sliced else by
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*ORDER)) - 1
    found = rows.withColumn(name, place.cast("long"))
    if not sliced:
        return found

    earlier = (
        Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = (
        rows.groupBy(*within)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*within, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return _beside(found, counts, within).withColumn(name, F.col(name) + F.col("before")).drop(
        "before"
    )


def running_total(rows: DataFrame, name: str, value: Column, by: list[str]) -> DataFrame:
    """Add `name`: the sum of `value` over the rows before each row of its group."""
    sliced = SLICE in rows.columns
    within = [*by, SLICE] if sliced else by
    before = Window.partitionBy(*within).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    if not sliced:
        return found

    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*within)
        .agg(F.sum(value).alias("total"))
        .select(*within, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("carried"))
    )
    return _beside(found, totals, within).withColumn(name, F.col(name) + F.col("carried")).drop("carried")


def _beside(rows: DataFrame, others: DataFrame, within: list[str]) -> DataFrame:
    """Rows with what `others` hold for their group; as in a window, NULL keys are one group."""
    others = others.withColumnsRenamed({c: f"_{c}" for c in within})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    return rows.join(others, same, "left").drop(*[f"_{c}" for c in within])
