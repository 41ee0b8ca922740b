"""Helpers shared by the operators of this package."""

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystride.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of anything but these six bytes, as a Java, RE2 and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of a few short columns that may be broadcast (about 16 MB).
BROADCAST_ROWS = 250_000
#: Bytes of text that a vectorised kernel handles at a time.
SLICE_BYTES = 2 << 20
#: Type of `row_key`.
ROW_KEY = "struct<file:bigint,at:bigint>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame) -> Column:
    """The file (hash of its path) and the place there of each row of a `stored` table.

    Unlike a number counted in the tasks, it is the same in every scan: how files are cut into tasks
    depends on the executors that are alive when the scan is planned.
    """
    hidden = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(hidden["file_path"]).alias("file"), hidden["row_index"].alias("at"))


def stored(docs: DataFrame) -> DataFrame:
    """`docs` if it is a scan of Parquet files, else a written copy of it."""
    try:
        docs.select(row_key(docs))
    except AnalysisException:
        return materialise(docs, "docs")
    return docs


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(quoted(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a written table, marked for broadcast if it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


Batches = Iterator[pa.RecordBatch]


def releasing(kernel: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`kernel` of mapInArrow, giving free memory back at its end: workers outlive their tasks."""

    @wraps(kernel)
    def run(found: Batches) -> Batches:
        try:
            yield from kernel(found)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


#: Settings of batches that tasks send to Python: rows of a table of texts are far larger than Spark's default expects.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def in_small_batches(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`job`, which takes a DataFrame first and writes what its kernels give, with the batches of BATCH.

    The default of 10,000 rows is some 30 MB of text, held by the JVM and by Python for each running task.
    """

    @wraps(job)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        conf = docs.sparkSession.conf
        before = {name: conf.get(name, None) for name in BATCH}
        try:
            for name, value in BATCH.items():
                conf.set(name, value)
            return job(docs, *args, **named)
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)

    return run


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of at most SLICE_BYTES or one row; null is empty."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end
