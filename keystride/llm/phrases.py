"""Collocations: frequent phrases of two and three words, scored against the counts of their parts.

Kernels hash whole slices of text with numpy: prefix polynomials over bytes give every word's hash, prefix polynomials over
the words' hashes every n-gram's, once for the fingerprint and once, with other bases, for a check number. A task
adds up equal fingerprints of its slices and emits each with its count, check and the key of one document that has
it; a shuffle adds those up. Phrases of a width are only sought where both shorter phrases in them
are frequent, by a bit filter of a fixed size (FILTER_BITS) that lets a few others through and drops none;
where a corpus fills the filter, more is shuffled and the result is the same.

Frequent fingerprints, and no others, get their text from the document they point at. A fingerprint whose check numbers
differ stands for several phrases: all its occurrences are counted once more by their text. Scores are exact
(decimal), the parts' counts are looked up by text, and frequent parts by a bounded broadcast.

A-Z are lower-cased. Texts fall into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`; phrases do not cross
pieces. Null text is empty, null lang is `und` and joins a lang of that name. Repeated rows count as often as they stand.
Ties of the score go by count and the phrase's bytes. An empty table gives an empty result; other columns play no part.
A text is hashed in runs of whole pieces of about RUN_BYTES; memory grows beyond that only with a single longer piece.
"""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import Batches, quoted, releasing, row_key, stored
from keystride.llm.hot import lookup
from keystride.session import materialise

WIDEST = 3
LEAST = 10
TOP = 2000
#: A phrase goes if a longer candidate around it has this many hundredths of its count.
COVERED = 50
#: Bits of the filter of frequent fingerprints, 8 MB.
FILTER_BITS = 1 << 26
#: Fingerprints that a task adds up before it emits them.
HELD = 1 << 17
#: Bytes of text that are hashed at a time.
RUN_BYTES = 1 << 18
#: Parts that a language's phrases are ranked in before the best of each part meet.
SALTS = 32

#: Odd bases of the polynomials (fingerprint, check) over bytes and over words.
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_U = np.uint64
#: A check number has the 32 upper bits of its hash.
CHECK_SHIFT = 32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xE9846AF9B1A615D)
    x = (x ^ (x >> _U(32))) * _U(0xE9846AF9B1A615D)
    return x ^ (x >> _U(28))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""

    def run(b: int) -> np.ndarray:
        out = np.full(n, b % 2**64, np.uint64)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 2**64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _kept_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        _POWERS[base] = _powers(base, max(n, 1 << 16))
    up, down = _POWERS[base]
    return up[:n], down[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[s:e] for each range, independent of where the range lies."""
    up, down = _kept_powers(base, len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=prefix[1:])
    return _mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of texts: bounds in the bytes, the piece and the text that each lies in, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        """langs: a number for the language of each text, mixed into all fingerprints."""
        self.data = _FOLD[data]
        kind = _KIND[data]
        inside = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        separators = np.cumsum(kind == 2, dtype=np.int64)
        self.piece = (separators[self.starts] if len(self.starts) else self.starts) + self.text
        self.seeds = langs[self.text]
        self.hashes = [range_hashes(self.data.astype(np.uint64) + _U(1), self.starts, self.ends, b) for b in _BYTE_BASES]

    def grams(self, width: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, fingerprints and checks of all runs of `width` words within a piece."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        at = np.arange(n)
        prints = [
            _mixed(range_hashes(h, at, at + width, b) ^ self.seeds[:n]) for h, b in zip(self.hashes, _WORD_BASES)
        ]
        prints[1] >>= _U(CHECK_SHIFT)
        if width > 1:
            # Piece numbers grow by separators and by texts, so equal numbers at both ends are one piece.
            at = np.flatnonzero((self.piece[:n] == self.piece[width - 1:]) & (self.text[:n] == self.text[width - 1:]))
        if bits < 64:
            prints[0] = prints[0] & _U((1 << bits) - 1)
        return at, prints[0][at], prints[1][at]

    def phrase(self, first: int, width: int) -> str:
        return " ".join(
            self.data[s:e].tobytes().decode() for s, e in zip(self.starts[first:first + width], self.ends[first:first + width])
        )


def in_filter(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints & _U(len(bits) * 8 - 1)
    return (bits[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, numbers of the texts): whole texts up to RUN_BYTES, longer ones cut between pieces."""
    first = 0
    while first < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1
        if end > first:
            yield data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first], np.arange(first, end)
            first = end
            continue
        at, last = int(offsets[first]), int(offsets[first + 1])
        while at < last:
            stop = min(at + RUN_BYTES, last)
            while stop < last:
                cut = np.flatnonzero(_KIND[data[stop:stop + RUN_BYTES]] == 2)
                if len(cut):
                    stop += int(cut[0])
                    break
                stop = min(stop + RUN_BYTES, last)
            yield data[at:stop], np.array([0, stop - at]), np.array([first])
            at = stop
        first += 1


def _words_of(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    """(words, number of each text in the batch, languages of the batch)."""
    texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8)
    langs = batch.column("lang").dictionary_encode()
    names = langs.dictionary.to_pylist()
    seeds = _mixed(np.array([zlib.crc32(x.encode()) + (len(x) << 32) for x in names], np.uint64))
    codes = langs.indices.to_numpy(zero_copy_only=False)
    for part, bounds, numbers in _runs(data, offsets):
        yield Words(part, bounds, seeds[codes[numbers]]), numbers, batch.column("lang")


class _Sums:
    """Counts by language and fingerprint, added up until HELD are there."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, lang: np.ndarray, prints: np.ndarray, checks: np.ndarray, doc: np.ndarray) -> None:
        order = np.lexsort((checks, prints))
        prints, checks, lang, doc = prints[order], checks[order], lang[order], doc[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
        at = np.flatnonzero(new)
        self._put(lang[at], prints[at], checks[at], doc[at], np.diff(np.append(at, len(prints))))

    def _put(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])

    def squeeze(self) -> None:
        lang, prints, checks, doc, counts = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((checks, prints))
        lang, prints, checks, doc, counts = (c[order] for c in (lang, prints, checks, doc, counts))
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (checks[1:] != checks[:-1])
        at = np.flatnonzero(new)
        self.parts, self.held = [], 0
        if len(at):
            self._put(lang[at], prints[at], checks[at], doc[at], np.add.reduceat(counts, at))

    def batches(self, names: list[str], piece: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for lang, prints, checks, doc, counts in self.parts:
            for i in range(0, len(lang), piece):
                part = slice(i, i + piece)
                yield pa.record_batch([
                    pa.DictionaryArray.from_arrays(pa.array(lang[part], pa.int32()), pa.array(names, pa.string())).cast(pa.string()),
                    pa.array(prints[part].view(np.int64)), pa.array(checks[part].view(np.int64)), pa.array(counts[part].astype(np.int64)), pa.array(doc[part]),
                ], ["lang", "print", "check", "n", "doc"])
        self.parts, self.held = [], 0


_COUNTS = "lang string, print long, check long, n long, doc long"


def _counting(width: int, shorter, bits: int, held: int) -> Callable[[Batches], Batches]:
    """Kernel: language, fingerprint, check, count and a document of the phrases of `width` words whose parts pass `shorter`."""

    def kernel(found: Batches) -> Iterator[pa.RecordBatch]:
        sums, numbers = _Sums(), {}
        for batch in found:
            docs = batch.column("doc").to_numpy()
            names = np.array([numbers.setdefault(x, len(numbers)) for x in batch.column("lang").to_pylist()], np.int32)
            for words, texts, _ in _words_of(batch):
                at, prints, checks = words.grams(width, bits)
                if shorter is not None and len(at):
                    # All runs of one word less, by their first word.
                    part_at, parts, _ = words.grams(width - 1, bits)
                    known = np.zeros(len(words.starts) + 1, bool)
                    known[part_at] = in_filter(shorter.value, parts)
                    keep = known[at] & known[at + 1]
                    at, prints, checks = at[keep], prints[keep], checks[keep]
                row = texts[words.text[at]]
                sums.add(names[row], prints, checks, docs[row])
                if sums.held > 2 * held:
                    sums.squeeze()
                    if sums.held > held:
                        yield from sums.batches(list(numbers))
        if sums.parts:
            sums.squeeze()
            yield from sums.batches(list(numbers))

    return releasing(kernel)


def _passing(pointed) -> Callable[[Batches], Batches]:
    """Kernel: the documents whose mark passes the filter."""

    def kernel(found: Batches) -> Iterator[pa.RecordBatch]:
        for batch in found:
            hit = in_filter(pointed.value, batch.column("mark").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(hit)).select(["lang", "text", "doc"])

    return releasing(kernel)


def _locating(bits: int) -> Callable[[Batches], Batches]:
    """Kernel: the text of the wanted fingerprints (width, print) of each document."""

    def kernel(found: Batches) -> Iterator[pa.RecordBatch]:
        for batch in found:
            wanted = batch.column("wanted")
            values, bounds = wanted.values, wanted.offsets.to_numpy()
            widths, prints, checks = (np.asarray(values.field(k)) for k in (0, 1, 2))
            langs, out = batch.column("lang").to_pylist(), ([], [], [], [])
            for words, texts, _ in _words_of(batch):
                grams = {w: words.grams(w, bits) for w in range(1, WIDEST + 1)}
                here = np.searchsorted(words.text, np.arange(len(texts) + 1))
                for i, row in enumerate(texts):
                    mine = slice(int(bounds[row]), int(bounds[row + 1]))
                    for width in np.unique(widths[mine]):
                        at, all_prints, all_checks = grams[int(width)]
                        lo, hi = np.searchsorted(at, here[i:i + 2])
                        # A phrase that only shares the fingerprint has another check.
                        asked = widths[mine] == width
                        ask, check = prints[mine][asked], checks[mine][asked].view(np.uint64)
                        known, place = np.unique(all_checks[lo:hi], return_index=True)
                        slot = np.minimum(np.searchsorted(known, check), max(len(known) - 1, 0))
                        for h in np.flatnonzero(known[slot] == check) if len(known) else ():
                            first = lo + place[slot[h]]
                            if all_prints[first].astype(np.int64) != ask[h]:
                                continue
                            out[0].append(langs[row])
                            out[1].append(int(width))
                            out[2].append(int(ask[h]))
                            out[3].append(words.phrase(int(at[first]), int(width)))
            yield pa.record_batch(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())],
                ["lang", "width", "print", "phrase"],
            )

    return releasing(kernel)


def _recounting(shared, bits: int) -> Callable[[Batches], Batches]:
    """Kernel: the phrases, as text, whose fingerprints pass the filter of their width, with their counts by batch."""

    def kernel(found: Batches) -> Iterator[pa.RecordBatch]:
        for batch in found:
            langs, counts = batch.column("lang").to_pylist(), {}
            for words, texts, _ in _words_of(batch):
                for width, filled in shared.value.items():
                    at, prints, _ = words.grams(width, bits)
                    hit = np.flatnonzero(in_filter(filled, prints))
                    for first, value in zip(at[hit], prints[hit].view(np.int64)):
                        key = (langs[texts[words.text[first]]], width, int(value), words.phrase(int(first), width))
                        counts[key] = counts.get(key, 0) + 1
            columns = zip(*[(*k, v) for k, v in counts.items()]) if counts else ((),) * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "width", "print", "phrase", "f"])

    return releasing(kernel)


def bit_filter(prints: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A filter of `size` bits of the column `print`; its words are built by the tasks, at most size / 64 reach the driver."""
    place = F.col("print").bitwiseAND(F.lit(size - 1))
    words = prints.select(F.shiftright(place, 5).alias("at"), F.expr(f"shiftleft(1L, int((print & {size - 1}) % 32))").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def documents_of(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, text and doc of every document: 32 bits of the file's hash and of the place there, mostly distinct."""
    docs = stored(docs)
    key = row_key(docs)
    doc = F.shiftleft(key["file"], 32).bitwiseOR(key["at"].bitwiseAND(F.lit(2**32 - 1)))
    return docs.select(
        F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"), quoted(text).alias("text"), doc.alias("doc")
    )


def frequent_prints(docs: DataFrame, least: int, bits: int = 64, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Frequent fingerprints (lang, width, print, f, low, high, doc) of all widths, and the words of each language (lang, n)."""
    spark = docs.sparkSession
    found, shorter, totals = [], None, None
    for width in range(1, WIDEST + 1):
        counted = docs.mapInArrow(_counting(width, shorter, bits, held), _COUNTS)
        sums = counted.groupBy("lang", "print").agg(
            F.sum("n").alias("f"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("doc").alias("doc")
        ).withColumn("width", F.lit(width))
        if width == 1:
            sums = materialise(sums, "words")
            totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
        found.append(materialise(sums.where(F.col("f") >= least), "frequent"))
        if width < WIDEST:
            shorter = spark.sparkContext.broadcast(bit_filter(found[-1]))
    frequent = found[0]
    for more in found[1:]:
        frequent = frequent.unionByName(more)
    return frequent, totals


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = 64, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to three words with f >= least (lang, width, phrase, f), and the words of each language (lang, n).

    docs: lang, text, doc, as `documents_of` gives them.
    """
    frequent, totals = frequent_prints(docs, least, bits, held)
    single, shared = frequent.where("low = high"), frequent.where("low <> high")

    # Each document meets the fingerprints that point at it, and only those documents go on.
    pointed = docs.sparkSession.sparkContext.broadcast(bit_filter(single.select(F.xxhash64("doc").alias("print")).distinct()))
    chosen = docs.withColumn("mark", F.xxhash64("doc")).mapInArrow(_passing(pointed), "lang string, text string, doc long")
    wanted = single.groupBy("doc").agg(F.collect_list(F.struct("width", "print", F.col("low").alias("check"))).alias("wanted"))
    located = chosen.join(wanted.hint("merge"), "doc").select("lang", "text", "wanted").mapInArrow(
        _locating(bits), "lang string, width int, print long, phrase string"
    )
    # Two rows may have one key, and both the phrase.
    located = located.dropDuplicates(["lang", "width", "print"])
    phrases = single.join(located, ["lang", "width", "print"]).select("lang", "width", "phrase", "f")

    widths = [r[0] for r in shared.select("width").distinct().collect()]
    if widths:
        filters = docs.sparkSession.sparkContext.broadcast({w: bit_filter(shared.where(F.col("width") == w)) for w in widths})
        again = docs.select("lang", "text").mapInArrow(_recounting(filters, bits), "lang string, width int, print long, phrase string, f long")
        again = again.join(shared.select("lang", "width", "print"), ["lang", "width", "print"], "left_semi")
        again = again.groupBy("lang", "width", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        phrases = phrases.unionByName(again.select("lang", "width", "phrase", "f"))
    return materialise(phrases, "phrases"), materialise(totals, "totals")


def _words(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (lang, width, phrase, a, l, r, score), each with the cut that scores lowest."""
    words = F.split("phrase", " ", -1)
    candidates = phrases.where("width > 1").select("lang", "width", "phrase", F.col("f").alias("a"), words.alias("words"))
    cuts = materialise(candidates.select(
        "lang", "width", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k")
    ).select("lang", "width", "phrase", "a", "k", _words(1, F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("width")).alias("right")), "cuts")
    for side, count in (("left", "l"), ("right", "r")):
        counts = phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cuts = materialise(lookup(cuts, counts, ["lang", side], "inner").drop(side), "cuts")
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r"))
    score = (a * a * F.lit(1_000_000).cast("decimal(7,0)"))
    lowest = F.min(F.struct(F.call_function("div", score, l * r).alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "width", "phrase", "a").agg(lowest).select(
        "lang", "width", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def _uncovered(phrases: DataFrame, candidates: DataFrame, covered: int) -> DataFrame:
    """Candidates without a longer one around them that has `covered` hundredths of their count."""
    longer = phrases.where("width > 2").select("lang", "width", "f", F.split("phrase", " ", -1).alias("words"))
    inner = longer.select("lang", "width", "f", "words", F.explode(F.sequence(F.lit(2), F.col("width") - 1)).alias("m"))
    inner = inner.select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(1), F.col("width") - F.col("m") + 1)).alias("at"))
    around = inner.select("lang", _words(F.col("at"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    joined = candidates.join(around, ["lang", "phrase"], "left")
    return joined.where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, lang: str = "lang", text: str = "text",
    bits: int = 64, held: int = HELD,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` phrases of each language."""
    phrases, totals = frequent_phrases(documents_of(docs, lang, text), least, bits, held)
    kept = _uncovered(phrases, scored(phrases), covered)
    best = [F.desc("score"), F.desc("a"), "phrase"]
    parts = Window.partitionBy("lang", "part").orderBy(*best)
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return kept.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
