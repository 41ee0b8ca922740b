"""Monitoring of scored rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.operators.slicing import per_group, running_total
from keystride.session import materialise

DRIFT_BINS = 10
DRIFT_FLOOR = 1e-6


def _metric_columns(labelled: bool) -> list[Column]:
    """Counts and rates in one pass.

    The two `_rate` columns divide by all predictions; `recall` and `fall_out` by the
    rows of their class. A risk of exactly 0.7 counts as high here.
    """
    columns = [
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg("risk_score").alias("average_risk_score"),
    ]
    if labelled:
        high = F.col("risk_score") >= S.HIGH_RISK
        positive, negative = F.col("label") == 1, F.col("label") == 0
        hits, alarms = F.count_if(positive & high), F.count_if(negative & high)
        total = F.count(F.lit(1))
        columns += [
            F.try_divide(hits, total).alias("true_positive_rate"),
            F.try_divide(alarms, total).alias("false_positive_rate"),
            F.try_divide(hits, F.count_if(positive)).alias("recall"),
            F.try_divide(alarms, F.count_if(negative)).alias("fall_out"),
        ]
    return columns


def metrics(scored: DataFrame, labelled: bool = True) -> DataFrame:
    return scored.agg(*_metric_columns(labelled))


def metrics_by_window(
    scored: DataFrame, time: str, width: str = S.METRICS_WINDOW, labelled: bool = True
) -> DataFrame:
    return (
        scored.groupBy(F.window(time, width).alias("w"))
        .agg(*_metric_columns(labelled))
        .select(F.col("w.start").alias("window_start"), "*")
        .drop("w")
    )


def area_by_group(
    scored: DataFrame, group: Column, score: str = "risk_score", label: str = "label", max_rows: int | None = None
) -> DataFrame:
    """group, positives, negatives and the exact area under ROC of each group, ties counting half.

    Rows are first counted by (group, score) on both sides of the shuffle. Each positive then needs the negatives
    below it: a running total, which cuts a group that holds most rows into ranges of scores and carries their
    totals on. Rows without score or label take no part; a group of one class has no area.
    """
    rows = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    cells = rows.groupBy(group.alias("group"), F.col(score).alias("t")).agg(
        F.count_if(F.col(label) == 1).alias("up"), F.count_if(F.col(label) == 0).alias("down"), F.lit(0).alias("pos")
    )
    cells = materialise(cells, "areas")
    placed = per_group(cells, lambda part: running_total(part, "below", F.col("down"), ["group"]), "group", max_rows)
    return placed.groupBy("group").agg(
        F.sum("up").alias("positives"), F.sum("down").alias("negatives"),
        F.sum(F.col("up") * (F.col("below") + F.col("down") / 2)).alias("wins"),
    ).select("group", "positives", "negatives", F.try_divide("wins", F.col("positives") * F.col("negatives")).alias("auc"))


def append_metrics(record: DataFrame, root: str, version: str, written_at: str) -> None:
    """A metrics row as JSON under a key named by its time."""
    record.withColumn("timestamp", F.lit(written_at)).coalesce(1).write.mode("append").json(
        f"{root}/metrics/{version}"
    )


def _has_risk() -> Column:
    return F.col("risk_score").isNotNull() & ~F.isnan("risk_score")


def unscored_share(scored: DataFrame) -> DataFrame:
    """Share of rows without a risk score, which drift leaves out."""
    return scored.agg(
        F.try_divide(F.count_if(~_has_risk()), F.count(F.lit(1))).alias("unscored_share")
    )


def _shares(scored: DataFrame, name: str) -> DataFrame:
    """Share of scored rows per risk bin; the total is summed from the at most ten bins."""
    cell = F.floor(F.col("risk_score") * DRIFT_BINS)
    bin_of = F.greatest(F.least(cell, F.lit(DRIFT_BINS - 1)), F.lit(0)).cast("int")
    counts = scored.filter(_has_risk()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.agg(
        F.collect_list(F.struct("bin", "n")).alias("bins"), F.sum("n").alias("total")
    )
    return pairs.select("total", F.explode("bins").alias("b")).select(
        F.col("b.bin").alias("bin"), (F.col("b.n") / F.col("total")).alias(name)
    )


def drift_bins(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline and current share of each risk bin and its term of the stability index."""
    joined = _shares(baseline, "baseline_share").join(
        _shares(current, "current_share"), "bin", "full_outer"
    )
    before = F.greatest(F.coalesce("baseline_share", F.lit(0.0)), F.lit(DRIFT_FLOOR))
    now = F.greatest(F.coalesce("current_share", F.lit(0.0)), F.lit(DRIFT_FLOOR))
    return joined.select(
        "bin", before.alias("baseline_share"), now.alias("current_share"),
        ((now - before) * F.log(now / before)).alias("term"),
    )


def drift_index(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return drift_bins(baseline, current).agg(F.sum("term").alias("drift"))


def alerts(observed: DataFrame) -> DataFrame:
    """(alert, value, threshold, fired) from one row of the observed quantities."""
    rules = {
        "false_positive_rate": S.ALERT_FALSE_POSITIVE_RATE,
        "model_drift": S.ALERT_DRIFT,
        "performance_degradation": S.ALERT_DEGRADATION,
    }
    return observed.select(F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("alert"),
            F.col(name).cast("double").alias("value"),
            F.lit(limit).alias("threshold"),
            F.coalesce(F.col(name) > limit, F.lit(False)).alias("fired"),
        )
        for name, limit in rules.items()
    ])).alias("r")).select("r.*")
