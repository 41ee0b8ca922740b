"""Merkle fingerprints of documents.

A text is cut into leaves: a leaf ends after a line end, or after a space that follows a punctuation
mark. The leaves, put together, are the text. Leaves up to a line end are a
paragraph; a section ends with a paragraph whose last leaf's hash begins with 0-3, so that an
insertion moves no later section. A paragraph's hash is that of its leaves' hashes, a section's
that of its paragraphs', the root that of its sections'. All are SHA-256.

The fingerprint is the top of the tree as text: the root, then for each section `/` and eight digits of its hash,
then `#` and a sketch: the SKETCH least of the distinct first eight digits of the leaves' hashes, parted
by commas. Equal roots mean equal texts; equal section labels need no look inside; `changed_sections`
lists the others. The likeness of two fingerprints is 1 if and only if the roots agree, else the
share of the leaves that both have among those that either has: exact up to SKETCH leaves, above an
estimate from the SKETCH least labels of both; n / (n + 1) where all n leaves agree and only their order or number differs.

`next document`: rows stand in ascending doc_id order (null first, rows of one doc_id by text
hash). Exact quantile rows of the ids cut the order into blocks; a block's first rows also visit
the block before as guests, so that each window sees who follows its last row and the text is
shuffled once.

Null text counts as empty: one section without leaves. A single row follows itself. An empty table gives an empty
result. Columns other than the two named ones play no part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import partitions, quoted, text_or_empty

#: Java and RE2 read it alike.
LEAF = r"(?s).*?(?:\n|[.,;:!?|] )|(?s).+$"
LABEL = 8
SKETCH = 128
BLOCKS_PER_PARTITION = 8
MOST_BLOCKS = 4096
LEAST_ID = -(1 << 63)


def fingerprint(text: Column) -> Column:
    """Root, section labels and sketch of the Merkle tree of a text without nulls."""
    leaves = F.regexp_extract_all(text, F.lit(LEAF), F.lit(0))
    labelled = F.transform(leaves, lambda x: F.struct(F.sha2(x, 256).alias("h"), x.endswith("\n").alias("end")))

    def section(s: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.split(s, ";"), lambda p: F.sha2(p, 256)), ""), 256)

    def top(leaves: Column) -> Column:
        marked = F.array_join(F.transform(leaves, lambda x: F.concat(
            x["h"], F.when(~x["end"], ",").when(x["h"] < "4", "/").otherwise(";"))), "")
        return F.transform(F.split(F.regexp_replace(marked, "[,;/]$", ""), "/"), section)

    def sketch(leaves: Column) -> Column:
        labels = F.array_distinct(F.transform(leaves, lambda x: F.substring(x["h"], 1, LABEL)))
        return F.array_join(F.slice(F.sort_array(labels), 1, SKETCH), ",")

    # Lambdas over arrays of one, so that leaves and sections are made once.
    return F.element_at(F.transform(F.array(labelled), lambda leaves: F.element_at(F.transform(F.array(top(leaves)), lambda all_: F.concat(
        F.sha2(F.array_join(all_, ""), 256),
        F.array_join(F.transform(all_, lambda h: F.concat(F.lit("/"), F.substring(h, 1, LABEL))), ""),
        F.lit("#"), sketch(leaves),
    )), 1)), 1)


def root(tree: Column) -> Column:
    return F.substring(tree, 1, 64)


def leaf_labels(tree: Column) -> Column:
    """The sketch: the least labels of the leaves, in order."""
    return F.split(F.substring_index(tree, "#", -1), ",")


def sections(tree: Column) -> Column:
    return F.split(F.substring_index(F.substring(tree, 66, 1 << 30), "#", 1), "/")


def changed_sections(left: Column, right: Column) -> Column:
    """Numbers (from 0) of the sections of `left` whose subtree `right` has not."""
    labels = sections(right)
    marks = F.transform(sections(left), lambda s, i: F.when(~F.array_contains(labels, s), i))
    return F.filter(marks, lambda i: i.isNotNull())


def likeness(left: Column, right: Column) -> Column:
    """From 0 to 1; 1 for equal texts only."""
    a, b = leaf_labels(left), leaf_labels(right)
    sketches = F.array(F.struct(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH).alias("least"), F.array_intersect(a, b).alias("both")))
    counts = F.transform(sketches, lambda x: F.struct(
        F.size(x["least"]).alias("n"), F.size(F.array_intersect(x["least"], x["both"])).alias("both")))
    share = F.element_at(F.transform(counts, lambda x: F.when(
        x["both"] < x["n"], x["both"].cast("double") / x["n"].cast("double")
    ).otherwise(x["n"].cast("double") / (x["n"] + 1).cast("double"))), 1)
    return F.when(root(left) == root(right), F.lit(1.0)).otherwise(share)


def _bounds(docs: DataFrame, order: Column) -> list[int]:
    """The least id and ids that cut the order into blocks; at most MOST_BLOCKS numbers."""
    blocks = min(MOST_BLOCKS, BLOCKS_PER_PARTITION * partitions(docs.sparkSession))
    found = docs.select(order.alias("o")).agg(
        F.min("o").alias("least"),
        F.percentile_approx("o", [i / blocks for i in range(1, blocks)], 20 * blocks).alias("cuts"),
    ).first()
    return sorted({found["least"], *(found["cuts"] or ())}) if found["least"] is not None else []


def with_next(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of (id, tie, ...) with the columns `keep` of the following row as next_*."""
    order = F.coalesce(F.col("id"), F.lit(LEAST_ID))
    bounds = _bounds(rows, order) or [0]
    cuts = F.lit(bounds)
    rows = rows.withColumn("order", order).withColumn("block", F.size(F.filter(cuts, lambda c: c <= F.col("order"))) - 1)
    first = F.element_at(cuts, F.col("block") + 1) == F.col("order")
    before = F.when(F.col("block") == 0, len(bounds) - 1).otherwise(F.col("block") - 1)
    here = F.struct(F.col("block").alias("at"), F.lit(False).alias("guest"))
    there = F.struct(before.alias("at"), F.lit(True).alias("guest"))
    placed = rows.withColumn("place", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    window = Window.partitionBy("place.at").orderBy("place.guest", "order", "tie")
    following = {f"next_{c}": F.lead(c).over(window) for c in keep}
    return placed.withColumns(following).where(~F.col("place.guest")).drop("order", "block", "place")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, and of the text with its last quarter replaced by the next
    document's beginning: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and edited_sections (numbers of the sections that differ)."""
    rows = docs.select(quoted(doc_id).cast("long").alias("id"), text_or_empty(text).alias("text"))
    trees = rows.withColumn("tie", F.sha2("text", 256)).withColumn("tree", fingerprint(F.col("text")))
    pairs = with_next(trees, ["text", "tree"])
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter)
    )
    pairs = pairs.select("id", "n_chars", "tree", "next_tree", edited.alias("edited"))
    pairs = pairs.withColumn("edited_tree", fingerprint(F.col("edited")))
    return pairs.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.col("tree").alias("fingerprint"), F.col("edited_tree").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        changed_sections(F.col("edited_tree"), F.col("tree")).alias("edited_sections"),
    )
