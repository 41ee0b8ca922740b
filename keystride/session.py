"""Spark session defaults and the shared folder for intermediate tables."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on; master and size come from the caller."""
    builder = (
        SparkSession.builder.appName("keystride")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Stream state on local disk with its log in the checkpoint, not on the heap.
        .config(PROVIDER, ROCKSDB)
        .config(
            "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"
        )
        .config("spark.ui.enabled", "false")
        # Call sites in error messages cost more than building the plan itself.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session's setting.

    A stream takes the setting when it starts, and a restarted one from its checkpoint.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local master may run without the setting: every executor must see the folder, so
    a cluster that names none is an error and not a reason to fall back to a local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="keystride-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/keystride/{label}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete the table that `materialise` wrote for `df`, which nothing may read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/keystride/" not in folder:
            raise ValueError(f"{folder} is no intermediate table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and
    keeps the columnar layout, so that later readers still prune columns.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
