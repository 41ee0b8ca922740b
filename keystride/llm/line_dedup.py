"""Boilerplate lines by the number of sites they stand on.

Every non-blank line, trimmed, is a key (MD5). HyperLogLog sketches of the sites, one per key, are
merged by the aggregation, map-side first, so a line that stands in every document costs one sketch per task.
Lines whose estimate is within the error band of the threshold get an exact distinct count; the
estimate decides the others. Lines on `least` sites or more are removed from every document.

A null site is a site of its own. Null text is empty: one blank line, which stays. Blank lines are
never removed. Repeated rows count one site. An empty table gives an empty result; other columns
play no part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystride.llm.common import quoted, row_key, small, stored, text_or_empty
from keystride.session import materialise

LEAST = 6
LG_K = 10
#: Standard errors of a sketch's estimate, 1.04 / sqrt(2^LG_K), that the band is wide.
ERRORS = 4


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_rows(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """row, pos, key and site of every non-blank line, written once."""
    site_key = F.coalesce(F.xxhash64(quoted(site).cast("string")), F.lit(0))
    site_key = F.when(quoted(site).isNull(), F.lit(-1)).otherwise(site_key).cast("long")
    rows = docs.select(row_key(docs).alias("row"), site_key.alias("site"), text_or_empty(text).alias("text"))
    rows = rows.select("row", "site", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    key = F.unhex(F.md5(F.trim("line"))).alias("key")
    return materialise(rows.where(F.trim("line") != "").select("row", "pos", key, "site"), "lines")


def widespread(lines: DataFrame, least: int = LEAST, lg_k: int = LG_K) -> DataFrame:
    """The keys on at least `least` sites."""
    band = least * ERRORS * 1.04 / 2 ** (lg_k / 2)
    estimates = materialise(
        lines.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
        .select("key", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= least - band - 1), "estimates",
    )
    near = F.abs(F.col("sites") - least) <= band + 1
    exact = (
        lines.join(small(materialise(estimates.where(near).select("key"), "near")), "key", "left_semi")
        .groupBy("key").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= least).select("key")
    )
    return materialise(estimates.where(~near & (F.col("sites") > least)).select("key").union(exact), "widespread")


def without_boilerplate(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text without the removed lines."""
    docs = stored(docs)
    lines = line_rows(docs, text, site)
    found = lines.join(small(widespread(lines, least)), "key", "left_semi")
    removed = found.groupBy("row").agg(F.collect_list("pos").alias("removed"))
    removed = materialise(removed.withColumn("removed", F.map_from_arrays("removed", "removed")), "removed")
    rows = docs.select(row_key(docs).alias("row"), quoted(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    # Texts meet their removed lines by a shuffle at every size: those lines grow with the documents.
    joined = rows.join(removed.hint("merge"), "row", "left").withColumn("lines", text_lines(F.col("text")))
    stay = F.filter("lines", lambda line, i: ~F.coalesce(F.map_contains_key("removed", i), F.lit(False)))
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.map_keys("removed")), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
    )
