"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

Units are the bytes of a text (tabs and the like as a space), ORDER of them to a gram, so the model grows with the
trusted text (labelled quality 1) and knows every script. Grams, line ends before the text and one behind, are
counted for each language inside the tasks and summed by a sharded aggregation. The lower orders' continuation
counts, the counts of counts that give the three discounts, and the interpolation are joins of these count tables
on language and context.

An interpolated model is a sum of figures of seen grams: ln p of a symbol is ln(1 / SYMBOLS), and for each order
what its context leaves to the lower order (0 for an unseen context) and what the gram, if seen, adds to that.
These figures are whole 2^-24ths, so that a text's sum does not depend on the order of adding. The figures used most, at most
HOT of them, whatever the corpus, meet the texts as a broadcast; for all others a text's distinct grams, with their
numbers, meet the sharded table by a join and are summed back. Where the cut falls changes no result.
Documents of a language without trusted text meet the model of all languages together.

No trusted document meets a model that it was counted in: a hash of the text deals the trusted texts
of a language into two halves, and each half meets the model of the other one. A document is
rejected if its perplexity is above the `quantile` of these figures of its language. A language
whose trusted texts are all in one half counts as one without trusted text, at every size.

A language without trusted text has no threshold, and all of its documents stay: what
its clean texts score under the other languages' model cannot be told from these languages. A
document without text has perplexity null and stays. A null language is a language of
its own. Null labels are not trusted. Of a doc_id with several labels, one of quality 1 is enough.
Without any trusted text nothing is rejected. An empty table gives an empty result; other columns play no part.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import ROW_KEY, fresh, in_small_batches, quoted, releasing, row_key, small, stored, text_slices
from keystride.llm.hot import lookup
from keystride.session import materialise

SYMBOLS = 256
ORDER = 4
BITS = 40  # of a gram's code, below the kind of its figure
UNIT = 1 << 24  # of a logarithm
HOT = 1 << 21  # figures in the broadcast, 12 bytes each
HELD_GRAMS = 1 << 21  # entries of partial tables in a task
QUANTILE = 0.995
QUANTILE_LEVELS = (34, 23, 12, 0)  # shifts of the buckets of a logarithm in 2^-40ths
ALL = "\x00all"  # the model of all languages
NONE = "\x00none"  # stands for a null language
WITHOUT = "\x00-"  # between a language and the half that its model was counted without
LINE_END = 10
_SYMBOL = np.arange(256, dtype=np.int64)
_SYMBOL[[9, 11, 12, 13]] = 32


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams of several texts in a row, and where each text's begin; its own are one more than its bytes."""
    lengths = np.diff(offsets)
    at = offsets + ORDER * np.arange(len(offsets))
    padded = np.full(int(at[-1]), LINE_END, np.int64)
    padded[np.arange(len(data)) + np.repeat(ORDER * np.arange(len(lengths)) + ORDER - 1, lengths)] = _SYMBOL[data]
    codes = np.zeros(max(len(padded) - ORDER + 1, 0), np.int64)
    for k in range(ORDER):
        codes = codes << 8 | padded[k:k + len(codes)]
    return codes, at


def counted(texts: DataFrame) -> DataFrame:
    """(lang, g, n) over all texts (lang, text): partial tables from the tasks, summed by key."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for batch in found:
            langs = np.array(batch["lang"].to_pylist(), object)
            for first, end, data, offsets in text_slices(batch, "text"):
                codes, at = grams_of(data, offsets)
                for lang in set(langs[first:end]):
                    mine = np.nonzero(langs[first:end] == lang)[0]
                    g, n = np.unique(np.concatenate([codes[at[i]:at[i + 1] - ORDER + 1] for i in mine.tolist()]), return_counts=True)
                    tables.setdefault(lang, []).append((g, n))
                    held += len(g)
                if held > HELD_GRAMS:
                    tables = {lang: [summed(parts)] for lang, parts in tables.items()}
                    held = sum(len(parts[0][0]) for parts in tables.values())
                    if held > HELD_GRAMS // 2:
                        yield from flush(tables)
                        tables, held = {}, 0
        yield from flush(tables)

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return g, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(g)).astype(np.int64)

    def flush(tables: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in tables.items():
            g, n = summed(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "g", "n"]
            )

    partial = texts.mapInArrow(releasing(batches), "lang string, g long, n long")
    return partial.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (lang, g, n, c): (lang, g, ctx, c, share) and (lang, ctx, c, rest): what each seen gram keeps of
    its context's mass after the modified discounts, and what the context leaves to the lower order."""
    of = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    fixed = (0.5, 0.75, 0.9)  # where a count of counts is missing
    d = [
        F.when(usable, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.01)), F.lit(float(k) - 0.01)))
        .otherwise(F.lit(fixed[k - 1])).alias(f"d{k}") for k in (1, 2, 3)
    ]
    of = small(materialise(of.select("lang", *d), "discounts"))
    grams = counts.withColumn("ctx", F.shiftright("g", 8)).join(of, "lang").withColumn(
        "d", F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d1"))
    )
    # Sums of whole numbers only: sums of doubles depend on the order of merging.
    once, twice = (F.count_if(F.col("n") == k) for k in (1, 2))
    contexts = grams.groupBy("lang", "ctx").agg(
        F.sum("n").alias("total"), F.sum("c").alias("c"),
        (once * F.first("d1") + twice * F.first("d2") + F.count_if(F.col("n") >= 3) * F.first("d3")).alias("off"),
    )
    contexts = materialise(contexts.select("lang", "ctx", "c", "total", (F.col("off") / F.col("total")).alias("rest")), "contexts")
    shares = grams.join(contexts.select("lang", "ctx", "total", "rest"), ["lang", "ctx"])
    return shares.select("lang", "g", "c", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"), "rest"), contexts


def model(counts: DataFrame) -> DataFrame:
    """The interpolated model of counts (lang, g, n) as figures (lang, key, value, c), written: for gram g of j
    symbols under key 2j << BITS | g what it adds when seen, for context g under key 2j + 1 << BITS | g what it
    leaves to the order below j; c is how often they occur in the counted texts."""
    levels = [counts.withColumn("c", F.col("n"))]
    for j in range(ORDER - 1, 0, -1):
        lower = levels[0].select("lang", F.col("g").bitwiseAND((1 << 8 * j) - 1).alias("g"), "c")
        levels.insert(0, materialise(lower.groupBy("lang", "g").agg(F.count("*").alias("n"), F.sum("c").alias("c")), "lower"))

    def figures(rows: DataFrame, kind: int, code: str, value: Column) -> DataFrame:
        key = F.lit(kind << BITS).bitwiseOR(F.col(code))
        return rows.select("lang", key.alias("key"), F.round(value * UNIT).cast("int").alias("value"), "c")

    out, low = None, None
    for j, level in enumerate(levels, 1):
        shares, contexts = _discounted(level)
        if low is None:
            shares = shares.withColumn("low", F.lit(1 / SYMBOLS))
        else:
            # A seen gram's lower order is seen as well, so this join loses none.
            shares = shares.withColumn("tail", F.col("g").bitwiseAND((1 << 8 * (j - 1)) - 1)).join(low, ["lang", "tail"])
        seen = materialise(shares.select("lang", "g", "c", "share", (F.col("rest") * F.col("low")).alias("under")), "seen")
        low = seen.select("lang", F.col("g").alias("tail"), (F.col("share") + F.col("under")).alias("low"))
        own = figures(seen, 2 * j, "g", F.log1p(F.col("share") / F.col("under")))
        both = own.unionByName(figures(contexts, 2 * j + 1, "ctx", F.log("rest")))
        out = both if out is None else out.unionByName(both)
    return materialise(out, "model")


def split(figures: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The figures that occur most, at most `hot` of them, and all others."""
    bucket = F.floor(F.log2("c") * 8)
    sizes = sorted(figures.groupBy(bucket.alias("bucket")).count().collect(), reverse=True)  # at most 8 * 63 rows
    least, held = 8 * 64, 0
    for size in sizes:
        held += size["count"]
        if held > hot:
            break
        least = size["bucket"]
    return figures.where(bucket >= least), figures.where(bucket < least)


def held(figures: DataFrame, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Keys in order and their values for each of `names`, from a bounded table."""
    ids = figures.sparkSession.createDataFrame(list(enumerate(names)), "id int, lang string")
    found = figures.join(F.broadcast(ids), "lang").select("id", "key", "value").toArrow()
    of, keys, values = (found[name].to_numpy() for name in ("id", "key", "value"))
    order = np.lexsort((keys, of))
    cuts = np.searchsorted(of[order], np.arange(len(names) + 1))
    return {name: (keys[order[a:b]], values[order[a:b]]) for name, a, b in zip(names, cuts[:-1], cuts[1:])}


def keys_of(grams: np.ndarray) -> Iterator[np.ndarray]:
    """The keys of the figures that grams of ORDER symbols ask for."""
    for j in range(1, ORDER + 1):
        yield 2 * j << BITS | grams & (1 << 8 * j) - 1
        yield 2 * j + 1 << BITS | grams >> 8 & (1 << 8 * (j - 1)) - 1


def _asked(text_of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, key and number of each distinct pair."""
    order = np.lexsort((keys, text_of))
    text_of, keys = text_of[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.nonzero(new)[0]
    return text_of[first], keys[first], np.diff(np.append(first, len(keys)))


@in_small_batches
def scored(
    docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", hot: int = HOT
) -> DataFrame:
    """row, doc_id, lang, model (the one that it met), trusted, n_symbols, perplexity, written once. `trusted` has the doc_ids (id) of the trusted texts."""
    spark, docs = docs.sparkSession, stored(docs)
    rows = docs.select(
        row_key(docs).alias("row"), quoted(doc_id).alias("doc_id"),
        F.coalesce(quoted(lang).cast("string"), F.lit(NONE)).alias("lang"), quoted(text).alias("text"),
    )
    ids = trusted.select(quoted(trusted.columns[0]).alias("id")).where("id is not null").distinct()
    ids = small(materialise(ids, "trusted")).withColumn("trusted", F.lit(True))
    rows = rows.join(ids, rows["doc_id"] == ids["id"], "left").drop("id").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    known = rows.where("trusted and text is not null and text <> ''").withColumn("half", half)
    # As many rows as languages have trusted text.
    halves = known.groupBy("lang").agg(F.count_distinct("half").alias("halves"))
    own = sorted(r["lang"] for r in halves.where("halves = 2").select("lang").collect())
    grams = counted(known.select(F.concat("lang", F.lit("\x00"), F.col("half").cast("string")).alias("lang"), "text"))
    grams = materialise(
        grams.select(F.substring_index("lang", "\x00", -1).cast("int").alias("half"), F.expr("substring(lang, 1, length(lang) - 2)").alias("lang"), "g", "n"),
        "grams",
    )
    counts = grams.where(F.col("lang").isin(own))
    # The model without a half has the counts of the other one.
    without = counts.select(F.concat("lang", F.lit(WITHOUT), (1 - F.col("half")).cast("string")).alias("lang"), "g", "n")
    whole = counts.groupBy("lang", "g").agg(F.sum("n").alias("n"))
    pooled = grams.groupBy("g").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "g", "n")
    counts = materialise(whole.union(without).union(pooled), "counts")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    schema = f"row {ROW_KEY}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, model string, trusted boolean, n_symbols long"
    if not names:
        return rows.select("row", "doc_id", "lang", F.lit(ALL).alias("model"), "trusted", F.lit(0).cast("long").alias("n_symbols"),
                           F.lit(None).cast("double").alias("perplexity"))
    often, rest = split(model(counts), hot)
    asks = not rest.isEmpty()
    tables = spark.sparkContext.broadcast(held(often, names))
    held_out = F.concat("lang", F.lit(WITHOUT), half.cast("string"))
    judge = F.when(F.col("trusted") & F.col("text").isNotNull(), held_out).otherwise(F.col("lang"))
    rows = rows.withColumn("model", F.when(F.col("lang").isin(own), judge).otherwise(F.lit(ALL)))
    floor = round(-math.log(SYMBOLS) * UNIT)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            models = np.array(batch["model"].to_pylist(), object)
            sums, sizes = np.zeros(len(models), np.int64), np.zeros(len(models), np.int64)
            for first, end, data, offsets in text_slices(batch, "text"):
                codes, at = grams_of(data, offsets)
                lengths = np.diff(offsets)
                for name in set(models[first:end]):
                    mine = np.nonzero((models[first:end] == name) & (lengths > 0))[0]
                    if not len(mine):
                        continue
                    here, place = np.unique(np.concatenate([codes[at[i]:at[i] + lengths[i] + 1] for i in mine]), return_inverse=True)
                    begins = np.concatenate([[0], np.cumsum(lengths[mine] + 1)])
                    keys, values = tables.value[name]
                    total, missed = np.full(len(here), floor, np.int64), []
                    for asked in keys_of(here):
                        where = np.searchsorted(keys, asked)
                        seen = np.zeros(len(here), bool)
                        inside = where < len(keys)
                        seen[inside] = keys[where[inside]] == asked[inside]
                        total[seen] += values[where[seen]]
                        missed.append((asked, ~seen))
                    sizes[first + mine] = lengths[mine] + 1
                    sums[first + mine] = np.add.reduceat(total[place], begins[:-1])
                    if asks:
                        text_of = np.repeat(first + mine, lengths[mine] + 1)
                        for asked, miss in missed:
                            at_miss = miss[place]
                            yield from questions(batch, *_asked(text_of[at_miss], asked[place[at_miss]]))
            none = pa.nulls(len(models), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(sizes), pa.array(sums), none, none], names=[*kept, "n_symbols", "total", "key", "n"]
            )

    def questions(batch: pa.RecordBatch, text_of: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(keys), pa.int64())
        if len(keys):
            which = batch.select(kept).take(pa.array(text_of))
            yield pa.RecordBatch.from_arrays([*which.columns, none, none, pa.array(keys), pa.array(n)], names=[*kept, "n_symbols", "total", "key", "n"])

    kept = ["row", "doc_id", "lang", "model", "trusted"]
    out = materialise(rows.mapInArrow(releasing(batches), schema + ", total long, key long, n long"), "scored")
    tables.destroy()
    pa.default_memory_pool().release_unused()
    scores = out.where("key is null").drop("key", "n")
    if asks:
        found = lookup(
            out.where("key is not null").select("row", "model", "key", "n"),
            rest.select(F.col("lang").alias("model"), "key", "value"), ["model", "key"], "inner",
        )
        more = found.groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("more"))
        scores = scores.join(more, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0))).drop("more")
    ppl = F.when(F.col("n_symbols") > 0, F.exp(-F.col("total") / UNIT / F.col("n_symbols")))
    scores = scores.withColumn("perplexity", ppl).drop("total")
    return materialise(scores, "perplexities") if asks else scores


def exact_quantiles(scores: DataFrame, quantile: float) -> DataFrame:
    """lang and threshold: of its n figures (lang, perplexity) the one at place ceil(quantile * n).

    Figures are counted in ordered buckets, and the bucket that holds the place is parted again, down to
    a 2^-40th of the logarithm, so that no language's figures are sorted in one place.
    """
    rows = materialise(scores.select("lang", "perplexity", F.floor(F.log("perplexity") * (1 << 40)).alias("fine")), "figures")
    sizes = rows.groupBy("lang").agg(F.ceil(F.count("*") * F.lit(quantile)).alias("place"))
    at = materialise(sizes.withColumn("bucket", F.lit(0).cast("long")), "places")
    upto = Window.partitionBy("lang").orderBy("bucket")
    for level, shift in enumerate(QUANTILE_LEVELS):
        part = rows if level == 0 else rows.join(small(at.select("lang", F.col("bucket").alias("within"))), "lang").where(
            F.shiftright("fine", QUANTILE_LEVELS[level - 1]) == F.col("within"))
        counts = part.groupBy("lang", F.shiftright("fine", shift).alias("bucket")).agg(F.count("*").alias("n"))
        found = counts.withColumn("upto", F.sum("n").over(upto)).join(small(at.select("lang", "place")), "lang")
        found = found.where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        at = materialise(found.select("lang", (F.col("place") - F.col("upto") + F.col("n")).alias("place"), "bucket"), "places")
    ends = rows.join(small(at), (rows["lang"] == at["lang"]) & (F.col("fine") == F.col("bucket")))
    return ends.groupBy(rows["lang"]).agg(F.max("perplexity").alias("threshold"))


def judged(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """`scored` with the threshold of its language and kept; with the model of all languages there is none."""
    of_lang = scores.where("trusted and perplexity is not null").where(F.col("model") != ALL)
    # One row per language with trusted text.
    limits = materialise(exact_quantiles(of_lang, quantile), "limits")
    kept = ~F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))
    return scores.join(small(limits), "lang", "left").withColumn("kept", kept)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return labels.where("quality = 1").select(quoted(doc_id).alias("id"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, perplexity, threshold, kept."""
    return judged(scored(docs, trusted_ids(labels)), quantile).select(
        "doc_id", F.when(F.col("lang") != NONE, F.col("lang")).alias("lang"), "n_symbols", "perplexity", "threshold", "kept"
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of `docs` that stay."""
    docs, row = stored(docs), fresh(docs, "row")
    dropped = materialise(
        judged(scored(docs, trusted_ids(labels)), quantile).where("not kept").select(F.col("row").alias(row)), "rejected"
    )
    return docs.withColumn(row, row_key(docs)).join(small(dropped), row, "left_anti").drop(row)
