"""Ensemble training and scoring."""

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride import schema as S
from keystride.plans.iforest import IsolationForest
from keystride.plans.scoring import ensemble_risk


def ensemble(
    features: str = "pca_features", key: str = "session_id", label: str | None = "label",
    trees: int = S.NUM_TREES, depth: int = S.MAX_DEPTH, contamination: float = S.CONTAMINATION,
    seed: int = S.SEED,
) -> Pipeline:
    """Isolation forest, then a random forest when there is a label to learn from."""
    stages = [IsolationForest(
        featuresCol=features, idCol=key, numTrees=trees, contamination=contamination, seed=seed,
    )]
    if label:
        stages.append(RandomForestClassifier(
            featuresCol=features, labelCol=label, predictionCol="rf_prediction",
            probabilityCol="rf_probability", rawPredictionCol="rf_raw",
            numTrees=trees, maxDepth=depth, seed=seed,
        ))
    return Pipeline(stages=stages)


def fit_ensemble(training: DataFrame, label: str | None = "label", **settings) -> PipelineModel:
    """Fit the isolation forest on all rows and the random forest on the labelled ones.

    Without a single label the isolation forest stays alone. The rows are read many times:
    hand in a written table.
    """
    labelled = training.filter(F.col(label).isNotNull()) if label else None
    if labelled is None or labelled.isEmpty():
        return ensemble(label=None, **settings).fit(training)
    isolation, forest = ensemble(label=label, **settings).getStages()
    return PipelineModel([isolation.fit(training), forest.fit(labelled)])


def score(model: PipelineModel, rows: DataFrame, rf_mode: str = "probability") -> DataFrame:
    """Model output plus `risk_score`; `rf_mode="label"` weighs the hard class instead."""
    scored = model.transform(rows)
    forest = None
    if "rf_prediction" in scored.columns:
        forest = (
            F.col("rf_prediction") if rf_mode == "label"
            # A forest that saw one class only has no second probability.
            else F.coalesce(F.get(vector_to_array("rf_probability"), F.lit(1)), F.lit(0.0))
        )
    return scored.withColumn("risk_score", ensemble_risk(F.col("iforest_prediction"), forest))


def area_under_roc(scored: DataFrame, column: str, label: str = "label") -> float:
    """Exact area: the score is not binned."""
    return BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol=column, metricName="areaUnderROC", numBins=0
    ).evaluate(scored.select(F.col(label).cast("double"), F.col(column).cast("double")))


@dataclass
class TrainingRun:
    model: PipelineModel
    record: DataFrame


RUN = """
    version string, contamination double, num_trees int, max_depth int,
    auc_roc double, risk_auc_roc double, model_path string
"""


def train(
    training: DataFrame, version: str, validation: DataFrame | None = None,
    root: str | None = None, label: str | None = "label", **settings,
) -> TrainingRun:
    """Fit the ensemble, evaluate it, save it below `root`, and record the run.

    `version` names the saved model; it is passed in so that a rerun repeats itself.
    """
    spark = training.sparkSession
    model = fit_ensemble(training, label, **settings)

    auc = risk_auc = None
    if validation is not None and len(model.stages) > 1:
        scored = score(model, validation.filter(F.col(label).isNotNull()))
        auc = area_under_roc(scored, "rf_prediction", label)
        risk_auc = area_under_roc(scored, "risk_score", label)

    path = None
    if root:
        path = f"{root}/models/{version}"
        model.write().overwrite().save(path)
    record = spark.createDataFrame([(
        version, settings.get("contamination", S.CONTAMINATION),
        settings.get("trees", S.NUM_TREES), settings.get("depth", S.MAX_DEPTH),
        auc, risk_auc, path,
    )], RUN)
    if root:
        record.coalesce(1).write.mode("append").json(f"{root}/runs")
    return TrainingRun(model, record)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def retrain_if_drifted(drift: float, training: DataFrame, version: str, **options):
    """A new training run when the drift index is over its threshold, else None."""
    if drift is None or drift <= S.ALERT_DRIFT:
        return None
    return train(training, version, **options)
