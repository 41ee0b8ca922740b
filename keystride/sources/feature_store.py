"""Versioned feature store (K3, K4, C6, C7): one Parquet partition per version."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride import schema as S

METADATA = "version string, timestamp string, feature_count int, row_count bigint"


def write_version(features: DataFrame, root: str, version: str, written_at: str) -> DataFrame:
    """Write one version, then its metadata.

    The rows are counted in the files just written, from their footers: the features are not
    computed a second time.
    """
    spark = features.sparkSession
    features.write.mode("overwrite").parquet(f"{root}/features/version={version}")
    rows = read_version(spark, root, version).count()
    record = spark.createDataFrame(
        [(version, written_at, len(features.columns), rows)], METADATA
    )
    record.coalesce(1).write.mode("overwrite").json(f"{root}/metadata/version={version}")
    return record


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/features/version={version}")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METADATA).json(f"{root}/metadata").select(
        "version", "timestamp", "feature_count", "row_count"
    )


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Version names, from the metadata: one small record per version."""
    return metadata(spark, root).select("version").distinct()


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The version written last by its metadata; only its own partition is opened."""
    written = F.struct(F.col("timestamp").try_cast("timestamp"), "version")
    newest = metadata(spark, root).agg(F.max_by("version", written)).first()[0]
    if newest is None:
        raise ValueError(f"no feature version below {root}")
    return read_version(spark, root, newest).withColumn("version", F.lit(newest))


def retention(known: DataFrame, as_of, days: int = S.RETENTION_DAYS) -> DataFrame:
    """(version, keep): versions older than `days` before `as_of` may be deleted.

    A name that is no time says nothing about age, so its version stays."""
    written = F.try_to_timestamp("version", F.lit(S.VERSION_FORMAT))
    oldest = F.to_timestamp(F.lit(as_of)) - F.expr(f"interval {days} days")
    return known.select("version", F.coalesce(written >= oldest, F.lit(True)).alias("keep"))
