"""Retraining as a job (C8): a challenger is trained on drift and promoted when it is better."""

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.plans import registry
from keystride.plans.training import area_under_roc

DECISION = """
    champion string, challenger string, drift double, champion_auc double, challenger_auc double,
    promoted boolean, in_use string
"""


def held_out(key: str, of: int = 4):
    """One row in `of`, told by its id: the same rows in every run, whatever trains on the others."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % of == 0


def retrain(
    spark: SparkSession, root: str, version: str, drift: float | None, fit: Callable[[], Any], load: Callable[[SparkSession, str], Any],
    score: Callable[[Any, DataFrame], DataFrame], rows: DataFrame, label: str = "label", threshold: float = S.ALERT_DRIFT,
) -> DataFrame:
    """One row of DECISION. rows: held-out rows that neither model was trained on, with labels.

    Without a model in use the first one is promoted. Otherwise nothing happens unless drift is over the
    threshold, and a challenger is saved and promoted only if it ranks the held-out rows better than the champion does.
    A run that dies leaves the champion in use; the same version may be trained again.
    """
    champion = registry.current(spark, root)
    if champion is not None and (drift is None or drift <= threshold):
        return spark.createDataFrame([(champion, None, drift, None, None, False, champion)], DECISION)
    challenger = fit()
    challenger.save(registry.version_path(root, version))

    labelled = rows.where(F.col(label).isNotNull())

    def area(model: Any) -> float:
        return area_under_roc(score(model, labelled), "risk_score", label)

    new = area(challenger)
    old = None if champion is None else area(load(spark, registry.version_path(root, champion)))
    better = old is None or new > old
    if better:
        registry.promote(spark, root, version)
    return spark.createDataFrame([(champion, version, drift, old, new, better, registry.current(spark, root))], DECISION)
