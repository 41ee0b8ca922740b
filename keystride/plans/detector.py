"""The session detector (M5-M10, M13, M16, K7, S7): fit, predict, save and load."""

from pyspark.sql import DataFrame, SparkSession

from keystride import schema as S
from keystride.plans.iforest import IsolationForest, IsolationForestModel
from keystride.plans.scoring import contribution_map, contributions, detector_risk
from keystride.plans.session_features import align
from keystride.plans.vectors import assembler, population_scale, population_stats
from keystride.session import materialise


class SessionDetector:
    """Isolation forest over scaled session features.

    The first fit fixes the feature names and their order; later inputs are aligned to it.
    """

    def __init__(self, contamination: float = S.CONTAMINATION, key: str = "session_id",
                 names: list[str] | None = None, seed: int = S.SEED):
        self.contamination, self.key, self.names, self.seed = contamination, key, names, seed
        self.stats: list[tuple[str, float, float]] | None = None
        self.forest: IsolationForestModel | None = None

    @property
    def is_fitted(self) -> bool:
        return self.forest is not None

    def _scaled(self, features: DataFrame) -> DataFrame:
        aligned = align(features, self.names, (self.key,))
        scaled = population_scale(aligned, self.stats, (self.key,))
        return assembler(self.names, "vector").transform(scaled)

    def fit(self, features: DataFrame) -> "SessionDetector":
        if self.names is None:
            self.names = [c for c in features.columns if c != self.key]
        # Read for the statistics, the sampling and the threshold: computed once.
        features = materialise(align(features, self.names, (self.key,)), "training")
        self.stats = population_stats(features, self.names)
        self.forest = IsolationForest(
            featuresCol="vector", idCol=self.key, scoreCol="raw_score",
            anomalyCol="is_anomaly", predictionCol="normality",
            contamination=self.contamination, seed=self.seed,
        ).fit(self._scaled(features))
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        """key, is_anomaly, risk_score, confidence, feature_importance, raw_score."""
        if not self.is_fitted:
            raise RuntimeError("fit the detector before predicting")
        scored = detector_risk(self.forest.transform(self._scaled(features)))
        return contributions(scored, self.names).select(
            self.key, "is_anomaly", "risk_score", "confidence",
            contribution_map(self.names).alias("feature_importance"), "raw_score",
        )

    def save(self, path: str) -> None:
        if not self.is_fitted:
            raise RuntimeError("an unfitted detector cannot be saved")
        self.forest.write().overwrite().save(f"{path}/forest")
        spark = self.forest.nodes.sparkSession
        rows = [(i, n, m, s, self.key) for i, (n, m, s) in enumerate(self.stats)]
        spark.createDataFrame(
            rows, "place int, feature string, mean double, scale double, key string"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SessionDetector":
        rows = spark.read.parquet(f"{path}/scaler").orderBy("place").collect()
        forest = IsolationForestModel.load(f"{path}/forest")
        detector = cls(
            forest.getOrDefault("contamination"), rows[0]["key"],
            [r["feature"] for r in rows], forest.getSeed(),
        )
        detector.stats = [(r["feature"], r["mean"], r["scale"]) for r in rows]
        detector.forest = forest
        return detector
