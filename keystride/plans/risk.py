"""From session features to a risk table, and the answer to analysis requests."""

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.functions.scalars import iso_timestamp, risk_tier
from keystride.plans import training
from keystride.plans.feature_build import vectorise
from keystride.plans.scoring import confidence_of, contributions, factor_list
from keystride.plans.session_features import align
from keystride.plans.vectors import population_scale, population_stats
from keystride.session import materialise
from keystride.sources.payloads import named_requests

# ---- fixed values: what a request without an answer is told --------------------------------
NO_ID = "Missing session_id"
NO_DATA = "No data found for this session"
REFUSED, UNKNOWN, SCORED = "refused", "no_data", "scored"


def model_rows(features: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Session features with their principal components, and labels where known."""
    aligned = align(features, S.SESSION_FEATURES)
    rows = vectorise(aligned, S.SESSION_FEATURES).features
    if labels is None:
        labels = rows.select("session_id", F.lit(None).cast("int").alias("label")).limit(0)
    return materialise(
        rows.join(labels.select("session_id", "label"), "session_id", "left"), "model-rows"
    )


def explain(scored: DataFrame, stats: list[tuple[str, float, float]]) -> DataFrame:
    """session_id, risk_score, confidence, tier and the three leading factors."""
    scaled = population_scale(scored, stats, ("session_id", "risk_score"))
    tier = risk_tier(F.col("risk_score"))
    return contributions(scaled, S.SESSION_FEATURES).select(
        "session_id", "risk_score", confidence_of("risk_score").alias("confidence"),
        tier.alias("tier"), factor_list(S.SESSION_FEATURES, tier).alias("factors"),
    )


def risk_table(rows: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Risk of every session in `rows`; fits the ensemble on them when no model is given."""
    model = model or training.fit_ensemble(rows)
    return explain(training.score(model, rows), population_stats(rows, S.SESSION_FEATURES))


def assess(requests: DataFrame, risks: DataFrame, at: Column) -> DataFrame:
    """The risk record of each request whose session has been scored."""
    return named_requests(requests).join(risks, "session_id").withColumn(
        "timestamp", iso_timestamp(at)
    )


def answers(requests: DataFrame, risks: DataFrame, at: Column) -> DataFrame:
    """One row for each request, batch or stream: its outcome, and the risk record or the reason why there is none.

    Requests without an id, or with an empty one, are refused and take no part in the join, so they
    do not meet in one task. `risks` holds one row for each session that can be answered.
    """
    known = [c for c in risks.columns if c != "session_id"]
    absent = [F.lit(None).cast(risks.schema[c].dataType).alias(c) for c in known]
    named = F.col("session_id").isNotNull() & (F.col("session_id") != "")
    refused = requests.filter(~F.coalesce(named, F.lit(False))).select(
        *requests.columns, F.lit(REFUSED).alias("outcome"), F.lit(NO_ID).alias("reason"), *absent
    )
    found = named_requests(requests).join(risks.withColumn("found", F.lit(True)), "session_id", "left")
    judged = found.select(
        *requests.columns, F.when(F.col("found"), SCORED).otherwise(UNKNOWN).alias("outcome"),
        F.when(F.col("found"), F.lit(None)).otherwise(NO_DATA).alias("reason"), *known,
    )
    return refused.unionByName(judged).withColumn("timestamp", iso_timestamp(at))
