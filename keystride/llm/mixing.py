"""Mixing sources to target weights by nested hash thresholds.

The mix shares a budget (150 % of all words) among the sources by weight. A source takes at most
`most` times its own words, and what it leaves is shared among the others by weight until none is
above. A target is met by whole copies of every document and one more copy of the documents whose
hash is below a threshold of the source. The threshold is found from histograms, without sorting:
words are summed by source and hash bucket, the bucket where the sum crosses the budget is refined
into sub-buckets, and so on to the 30th bit. Thresholds are nested: a larger budget takes what a
smaller one took, and more. Rows that share the boundary cell, because they share a doc_id or have
none, are told apart by a hash of the text in the same way, and repeated rows by a hash of their
place in the table. Rows that share even the last cell split what is left, each giving the same
fraction of its words.

Null text has no words, and takes none. A null source is one source, the last. Of equal rows some
may be taken once more than others. A source without words has target 0. The table of sources is
assumed to fit one task; documents are only aggregated or filtered.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import WORD, fresh, quoted, row_key, small, stored, text_or_empty
from keystride.session import materialise

WEIGHTS = (5, 2, 1)
MOST = 2
LEVELS = (20, 10, 0)  # shifts of the nested buckets of 1,024
CELLS = ("cell", "text_cell", "row_cell")


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def hash_cell(doc_id: str = "doc_id") -> Column:
    """30 bits of a hash of the id."""
    label = F.concat(F.lit("mix:"), F.coalesce(quoted(doc_id).cast("string"), F.lit("null")))
    return F.shiftright(F.conv(F.substring(F.md5(label), 1, 8), 16, 10).cast("long"), 2)


def cells(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """30 bits of hashes of the id, the text, and the row's place in `docs`, which is `stored`."""
    low = (1 << 30) - 1
    return {
        "cell": hash_cell(doc_id), "text_cell": F.xxhash64(text_or_empty(text)).bitwiseAND(low),
        "row_cell": F.xxhash64(row_key(docs)).bitwiseAND(low),
    }


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and cells of every row of a `stored` table, written once."""
    return materialise(docs.select(
        quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), words(text).alias("size"),
        *[c.alias(name) for name, c in cells(docs, doc_id, text).items()],
    ), "sized")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, base (whole copies) and extra (words of one more copy).

    Sources stand by code point, null last. In the order of size per weight, a source is held at
    its limit if the level that the others would reach is above it. All sums are whole numbers and
    each target takes one division, so that other engines get the same doubles.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("place"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    place = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    ranked = (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", place)
        .withColumn("weight", weight.cast("long"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(after))
        .withColumn("full", 2 * MOST * F.col("source_size") * F.col("weight_from")
                    <= F.col("weight") * (3 * F.col("total") - 2 * MOST * F.col("full_before")))
        .withColumn("left", 3 * F.col("total") - 2 * MOST * F.sum(
            F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything))
        .withColumn("weight_left", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    )
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(
        (F.col("left") * F.col("weight")).cast("double") / (2 * F.col("weight_left")).cast("double")
    )
    base = F.when(F.col("full"), F.lit(MOST)).otherwise(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    return ranked.withColumn("target", target).withColumn("base", base.cast("long")).select(
        "source", "source_size", "target", "base",
        (F.floor("target") - F.col("base") * F.col("source_size")).alias("extra"),
    )


def _same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def _crossing(wanted: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """For each source of `wanted` (source, extra): the cell of `column` at which the words of `rows`
    pass extra (prefix, -1 if they do not), what that cell is to give (extra), its words and rows."""
    zero = F.lit(0).cast("long")
    plan = materialise(wanted.select("source", "extra", zero.alias("prefix")), "wanted")
    for level, shift in enumerate(LEVELS):
        bounds = plan.select("source", "extra", F.col("prefix").alias("within"))
        part = rows if level == 0 else rows.join(
            small(bounds.select("source", "within").withColumnRenamed("source", "s")),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(column, shift + 10) == F.col("within")),
        )
        found = part.groupBy("source", F.shiftright(column, shift).alias("bucket")).agg(
            F.sum("size").alias("bucket_size"), F.count_if(F.col("size") > 0).alias("bucket_rows"))
        running = Window.partitionBy("source").orderBy("bucket")
        crossing = (
            found.where("bucket_size > 0")
            .withColumn("upto", F.sum("bucket_size").over(running))
            .join(small(bounds.select(F.col("source").alias("s"), "extra")), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("bucket_size") <= F.col("extra")))
            .select(F.col("s").alias("at"), "bucket", "bucket_size", "bucket_rows",
                    (F.col("extra") - F.col("upto") + F.col("bucket_size")).alias("rest"))
        )
        plan = materialise(
            plan.join(crossing, plan["source"].eqNullSafe(crossing["at"]), "left").select(
                "source", F.coalesce("rest", zero).alias("extra"),
                # A source without words has nothing below any threshold.
                F.coalesce("bucket", F.lit(-1).cast("long")).alias("prefix"),
                F.coalesce("bucket_size", F.lit(1).cast("long")).alias("cell_size"),
                F.coalesce("bucket_rows", zero).alias("cell_rows"),
            ), "thresholds",
        )
    return plan


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """targets, the cell of each of CELLS at which the extra copy ends (null: not looked at), and
    the words and share of the last one."""
    plan = materialise(targets(rows, weights), "targets")
    at = _crossing(plan, rows, CELLS[0])
    plan = plan.drop("extra").join(at.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    plan = plan.drop("s").withColumnRenamed("prefix", f"{CELLS[0]}_end")
    for column, finer in zip(CELLS, CELLS[1:]):
        # Rows that share a boundary cell, with where the others end.
        crowded = materialise(at.where("cell_rows > 1"), "crowded")
        if crowded.isEmpty():
            plan = plan.withColumn(f"{finer}_end", F.lit(None).cast("long"))
            continue
        ends = [c.alias(n) for c, n in ((F.col("source"), "s"), (F.col("prefix"), "end"))]
        part = rows.join(small(crowded.select(*ends)), F.col("source").eqNullSafe(F.col("s")) & (F.col(column) == F.col("end")))
        rows = materialise(part.select(*rows.columns), "boundary")
        at = _crossing(crowded, rows, finer)
        deeper = at.select(*[F.col(c).alias(f"{c} deeper") for c in at.columns])
        plan = plan.join(deeper, F.col("source").eqNullSafe(F.col("source deeper")), "left").withColumns(
            {c: F.coalesce(f"{c} deeper", c) for c in ("extra", "cell_size", "cell_rows")}
        ).withColumnRenamed("prefix deeper", f"{finer}_end").drop(*[c for c in deeper.columns if c != "prefix deeper"])
    return materialise(plan, "thresholds")


def _more(size: Column, cell: dict[str, Column], plan: dict[str, Column]) -> Column:
    """Words of the extra copy that a row gives."""
    out = F.floor(size * plan["extra"] / plan["cell_size"])
    for name in reversed(CELLS):
        end = plan[f"{name}_end"]
        finer = F.when(cell[name] < end, size).when(cell[name] > end, 0).otherwise(out)
        out = F.when(end.isNull(), F.floor(size * plan["extra"] / plan["cell_size"])).otherwise(finer)
    return out.cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = sized(stored(docs), doc_id, text, source)
    plan = thresholds(rows, weights)
    more = _more(F.col("size"), {c: F.col(c) for c in CELLS}, {c: F.col(c) for c in plan.columns if c != "source"})
    taken = (F.col("base") * F.col("size") + more).cast("long")
    return rows.join(small(plan), _same_source(rows, plan)).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken")
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time perhaps cut.

    A document of which the mix takes only some words more comes once more as those first words
    with the white space before each; documents without words follow their source's whole copies.
    """
    docs = stored(docs)
    plan = thresholds(sized(docs, doc_id, text, source), weights)
    plan = plan.select(*[F.col(c).alias(f"mix {c}") for c in plan.columns])
    size, copy = fresh(docs, "mix words"), fresh(docs, "mix copy")
    joined = docs.select("*", words(text).alias(size), *[c.alias(f"mix {n} of row") for n, c in cells(docs, doc_id, text).items()])
    joined = joined.join(small(plan), quoted(source).eqNullSafe(F.col("`mix source`")))
    of = {c.removeprefix("mix "): quoted(c) for c in plan.columns}
    given = F.when(quoted(size) > 0, _more(quoted(size), {c: quoted(f"mix {c} of row") for c in CELLS}, of))
    # Words given of the extra copy: all of them are a copy more.
    whole = quoted("mix base") + F.when(given == quoted(size), 1).otherwise(0)
    part = F.when(given < quoted(size), given).otherwise(0).cast("long")
    lengths = F.array_repeat(F.lit(None).cast("long"), whole.cast("int"))
    lengths = F.when(part > 0, F.concat(lengths, F.array(part))).otherwise(lengths)
    # Pieces of one word and the white space before it; the join of all of them is the text.
    start = F.array_join(F.slice(F.regexp_extract_all(text_or_empty(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)),
                                 F.lit(1), F.greatest(quoted(copy), F.lit(1)).cast("int")), "")
    return joined.withColumn(copy, F.explode(lengths)).select(*[
        (F.when(quoted(copy).isNull(), quoted(c)).otherwise(start).alias(c) if c == text else quoted(c)) for c in docs.columns
    ])
