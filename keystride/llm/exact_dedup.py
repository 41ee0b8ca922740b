"""Exact duplicates, with frequent digests removed before the shuffle.

Texts are equal when they are identical after lower-casing A-Z. One scan writes the digests;
everything after it reads that narrow table. A Misra-Gries pass (Spark's `freqItems`) names at
most 1/support digests that can exceed the support. Their exact counts and last rows are
aggregated map-side, the verified ones are broadcast (at most 1/support rows) and settle their
copies without a shuffle. All other digests have at most support * rows copies, and take
the ordinary way: aggregate by digest, then join.

Null text counts as empty. A null doc_id is smaller than any other. If the largest doc_id of a
group occurs in several rows, one of them stays. An empty table gives an empty result. Columns
other than the two named ones play no part.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystride.llm.common import ascii_lower, fresh, quoted, row_key, small, stored, text_or_empty
from keystride.session import materialise

SUPPORT = 1 / 1024


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sha and place of the row in the table, written once."""
    docs = stored(docs)
    return materialise(docs.select(
        quoted(doc_id).alias("doc_id"),
        F.sha2(ascii_lower(text_or_empty(text)), 256).alias("sha"),
        row_key(docs).alias("row"),
    ), "digests")


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """sha, group_size and top (doc_id, row) of the digests with more than support * rows copies."""
    candidates = rows.stat.freqItems(["sha"], support).select(F.explode("sha_freqItems").alias("sha"))
    least = rows.count() * support
    return materialise(
        rows.join(F.broadcast(candidates), "sha").groupBy("sha")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top"))
        .where(F.col("group_size") > least),
        "frequent",
    )


def judged(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Every row of `digests` with keep_id, group_size and kept."""
    frequent = frequent_digests(rows, support)
    rest = rows.join(F.broadcast(frequent.select("sha")), "sha", "left_anti")
    groups = rest.groupBy("sha").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")
    )
    both = rows.join(F.broadcast(frequent), "sha").unionByName(rest.join(groups, "sha"))
    return both.select(
        "doc_id", "row", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"), "sha",
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return judged(digests(docs, doc_id, text), support).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay."""
    docs, row = stored(docs), fresh(docs, "row")
    dropped = materialise(
        judged(digests(docs, doc_id, text), support).where(~F.col("kept"))
        .select(F.col("row").alias(row)), "dropped",
    )
    return docs.withColumn(row, row_key(docs)).join(small(dropped), row, "left_anti").drop(row)
