"""Feature vectors (M1-M5): assembly, the two scalings, and principal components."""

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride import schema as S


def assembler(names: list[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol=output)


def standard_scaler() -> StandardScaler:
    return StandardScaler(
        inputCol="features", outputCol="scaled_features", withMean=True, withStd=True
    )


def feature_pipeline(names: list[str] | None = None, k: int = S.PCA_COMPONENTS) -> Pipeline:
    """Assemble, standardise (sample deviation) and reduce to `k` components.

    Feed it aligned features: the assembler refuses NULL.
    """
    return Pipeline(stages=[
        assembler(names or S.ACTIVITY_VECTOR),
        standard_scaler(),
        PCA(k=k, inputCol="scaled_features", outputCol="signless_features"),
    ])


def component_signs(reduction: PCAModel) -> ElementwiseProduct:
    """The stage that turns each component so that its loading of largest size is positive.

    An eigenvector is known up to its sign, which may differ from one fit to the next. Of loadings of
    one size (to six digits) the first feature's counts.
    """
    loadings = reduction.pc.toArray()
    size = np.abs(loadings)
    leading = np.argmax(size >= size.max(axis=0) - 1e-6, axis=0)
    signs = np.where(loadings[leading, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)
    return ElementwiseProduct(
        scalingVec=Vectors.dense(signs), inputCol=reduction.getOutputCol(), outputCol="pca_features"
    )


def fit_features(table: DataFrame, names: list[str] | None = None, k: int = S.PCA_COMPONENTS) -> PipelineModel:
    """`feature_pipeline` fitted on `table`, with the components' signs fixed; it can be saved whole."""
    fitted = feature_pipeline(names, k).fit(table)
    return PipelineModel([*fitted.stages, component_signs(fitted.stages[-1])])


def long_rows(vectors: DataFrame, column: str, names: list[str], key: str = "session_id"):
    """A vector column as (key, feature, value) rows."""
    labels = F.array(*[F.lit(n) for n in names])
    return vectors.select(
        key, F.posexplode(vector_to_array(column)).alias("i", "value")
    ).select(key, F.element_at(labels, F.col("i") + 1).alias("feature"), "value")


def population_stats(features: DataFrame, names: list[str]) -> list[tuple[str, float, float]]:
    """(name, mean, scale) with the population deviation; a constant column scales by 1.

    One aggregate row of two numbers per feature is all that reaches the driver.
    """
    row = features.agg(
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[F.stddev_pop(n).alias(f"{n}_scale") for n in names],
    ).first()
    if row[f"{names[0]}_mean"] is None:
        raise ValueError("no training rows")
    return [(n, row[f"{n}_mean"], row[f"{n}_scale"] or 1.0) for n in names]


def population_scale(features: DataFrame, stats, keep: tuple[str, ...] = ("session_id",)):
    return features.select(
        *keep, *[((F.col(n) - mean) / scale).alias(n) for n, mean, scale in stats]
    )
