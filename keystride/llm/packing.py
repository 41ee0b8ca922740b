"""Packing documents into sequences by non-negative least squares over a length histogram.

A document's ids and its end id are cut into pieces of a whole window and a rest. Whole pieces are
sequences of their own. The rests are counted by length class (`step` ids wide, rounded up). Every
combination of up to three classes that fills the window is a column; the repeat counts that best
explain the histogram are the non-negative least-squares solution, rounded down. What the rounding
and the misfit leave is packed greedily, largest class first, each pattern as often as it can be
repeated. Both work on the histogram (window / step numbers), never on documents, so the plan costs
the same at any size. Documents are then dealt to the plan by their rank within their class: ranks
come from counts by (class, shard), so a class that holds a third of all rows is ranked in shards.

Null text is empty: one piece with the end id. Documents of one doc_id are separate documents. An empty table
gives an empty result; other columns play no part.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import BROADCAST_ROWS, in_small_batches, quoted, releasing, text_or_empty
from keystride.llm.tokens import documents_ids, worker_encoder
from keystride.session import materialise

WINDOW = 2048
STEP = 8
SHARD_PIECES = 1 << 18
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
INTERVALS = "cls int, low long, high long, first_sequence long, slot int"


@in_small_batches
def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document, written once; `row` is the document's place in the table."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), quoted(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")
    )

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, True, False)
        for batch in found:
            out = []
            names = zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist())
            for (row, name), ids in zip(names, documents_ids(encoder, batch["text"])):
                data = ids.astype("<u4").tobytes()
                for start in range(0, len(ids), window):
                    part = data[4 * start:4 * (start + window)]
                    out.append((row, name, start, len(part) // 4, zlib.crc32(part), len(ids)))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return materialise(rows.mapInArrow(releasing(batches), PIECES), "pieces")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        if free.all() or gain.max(initial=-np.inf) <= slack:
            break
        free[gain.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                break
            stuck = free & (z <= 0)
            move = (x[stuck] / np.maximum(x[stuck] - z[stuck], 1e-300)).min()
            x = x + move * (z - x)
            free &= x > 1e-9
            x[~free] = 0
        x = z
    return x


def combinations(units: int) -> list[tuple[int, ...]]:
    """Up to three classes, largest first, that fill `units` exactly."""
    out = [(units,)]
    for a in range(units - 1, 0, -1):
        for b in range(min(a, units - a), 0, -1):
            c = units - a - b
            if c <= b:
                out.append((a, b, c) if c else (a, b))
    return out


def plan(histogram: dict[int, int], units: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes, repeats) that together use every counted piece exactly once."""
    left = np.zeros(units + 1, np.int64)
    for cls, n in histogram.items():
        left[cls] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    columns = [c for c in combinations(units) if all(left[k] for k in c)]
    if columns:
        a = np.zeros((units + 1, len(columns)))
        for j, classes in enumerate(columns):
            np.add.at(a[:, j], list(classes), 1)
        # Classes weigh by their length: a misfit there leaves so much more to the greedy part.
        weight = np.sqrt(np.arange(units + 1) / units)[:, None]
        counts = np.floor(nnls(a * weight, left * weight[:, 0]) + 1e-6).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            use = a[:, j].astype(np.int64)
            n = int(min(counts[j], (left[use > 0] // use[use > 0]).min()))
            if n > 0:
                patterns.append((columns[j], n))
                left -= n * use
    while left.any():
        room, use = units, np.zeros(units + 1, np.int64)
        for cls in range(units, 0, -1):
            while cls <= room and left[cls] > use[cls]:
                use[cls] += 1
                room -= cls
        n = int((left[use > 0] // use[use > 0]).min())
        patterns.append((tuple(int(c) for c in range(units, 0, -1) for _ in range(use[c])), n))
        left -= n * use
    return patterns


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of a class go to which slot: (class, low, high, sequence of rank low, slot)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for classes, n in patterns:
        for slot, cls in enumerate(classes):
            low = used.get(cls, 0)
            out.append((cls, low, low + n, sequence, slot))
            used[cls] = low + n
        sequence += n
    return out


def ranked(pieces: DataFrame, counts: dict[int, int], most: int = SHARD_PIECES) -> DataFrame:
    """The pieces with their rank within their class, counted from (class, shard) totals.

    `counts` has the pieces of each class: a class has a shard for every `most` of them, so that tasks sort about as
    many at every size.
    """
    shards = F.element_at(F.create_map(*[F.lit(x) for cls, n in counts.items() for x in (cls, -(-n // most))]), F.col("cls"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), shards).cast("int"))
    totals = pieces.groupBy("cls", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("cls").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("cls", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("cls", "shard").orderBy("row", "start")) - 1
    pieces = pieces.withColumn("inside", inside)
    # A row for each class and each `most` pieces.
    before = F.broadcast(before) if len(counts) + sum(counts.values()) // most <= BROADCAST_ROWS else before
    return pieces.join(before, ["cls", "shard"]).withColumn(
        "rank", F.col("before") + F.col("inside")
    ).drop("inside", "before", "shard")


def place(pieces: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """The pieces with the sequence each goes to and its offset there."""
    spark = pieces.sparkSession
    units = window // step
    whole = F.col("length") == window
    pieces = pieces.withColumn("cls", F.when(whole, 0).otherwise(F.ceil(F.col("length") / step)).cast("int"))
    counts = {r["cls"]: r["count"] for r in pieces.groupBy("cls").count().collect()}  # units + 1 rows at most
    if not counts:
        return pieces.drop("cls").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    rows = ranked(pieces, counts)
    n_whole = counts.pop(0, 0)
    dealt = intervals(plan(counts, units))
    # As many rows as the plan has slots: it depends on the histogram alone.
    table = F.broadcast(spark.createDataFrame(dealt, INTERVALS)) if dealt else spark.createDataFrame([], INTERVALS)
    alone = rows.where("cls = 0").select(
        *pieces.drop("cls").columns, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    table = table.withColumnRenamed("cls", "of")
    dealt_out = rows.where("cls > 0").join(
        table, (F.col("cls") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ).withColumn("sequence_id", F.lit(n_whole) + F.col("first_sequence") + F.col("rank") - F.col("low"))
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return alone.unionByName(dealt_out.select(*pieces.drop("cls").columns, "sequence_id", offset.alias("offset")))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, step: int = STEP, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return place(cut(docs, tokenizer, window, doc_id, text), window, step).drop("row")
