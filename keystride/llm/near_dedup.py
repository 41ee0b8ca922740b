"""Near duplicates by an inverted join over MinHash signature coordinates.

A document's set is its distinct two-word shingles (fewer words: the whole sequence; no word: empty
and linked with nothing). Documents are linked when the sets' Jaccard similarity is at least
`percent` / 100, confirmed on the full sets.

1. One scan writes for each text a key of its set and, for sets that can be similar to another one, a signature of
   COORDINATES minima. Equal sets are one class from here on.
2. Every class is posted under each (coordinate, value). Values are counted (map-side first), and
   ordered by count. Two classes that agree in at least MATCHES coordinates share a value among the
   COORDINATES - MATCHES + 1 rarest of each: only these prefixes are joined, and values that one class
   alone has use up places of the prefix without being posted.
3. Lists of up to LIST classes give pairs, whose collisions are counted on the signatures; pairs
   above the threshold are kept. The classes of longer lists are posted anew under BANDS keys, each the hash of
   BAND coordinates, and short lists of these give pairs alike. In a long one each class is compared with the least
   one: those that differ from it in at most COORDINATES - MATCHES + NEAR coordinates are tied to it, among them all
   partners of those that differ in at most NEAR. If some differ more, all that differ in more than NEAR meet in
   pairs of blocks of LIST_ROWS, which give pairs above the threshold that span all such pairs.
4. Components of what is kept are the families that can contain links.
5. The full sets of each family meet once: in one group if it is small, otherwise in pairs of blocks
   of bounded size, only between neighbouring size classes. Intersections are matrix products over
   slices of the vocabulary; a group gives links that span its links, not all pairs.
6. Components of the links, named by the least doc_id.

A pair at exactly 0.8 has fewer than 36 of 64 matches with a probability of about 1e-5, and shares no band with
one of 3e-7, and a more similar pair with much less; no other step loses a link, and none has a cap.

Null text is empty. A null doc_id is never the least unless alone. Rows of one doc_id are separate
documents with equal answers if their texts are equal. An empty table gives an empty result; other
columns play no part.
"""

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import BROADCAST_ROWS, ROW_KEY, fresh, in_small_batches, quoted, releasing, row_key, small, stored, text_slices
from keystride.llm.components import components
from keystride.session import materialise

COORDINATES = 64
MATCHES = 36
PERCENT = 80
WIDTH = 2
LIST = 8
NEAR = 18
BAND = 3
BANDS = COORDINATES // BAND
LIST_ROWS = 128
FAMILY_ROWS = 128
BLOCK_SHINGLES = 1 << 20
#: Wider than the ratio of linked sizes (1.25), so that linked classes are neighbours.
SIZE_BASE = 1.3
SLICE_COLUMNS = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = np.random.default_rng(20240131)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_FACTOR = _RANDOM.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << n.bit_length(), _BASE, np.uint64))
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, and the text each is in."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    begin = np.nonzero(start)[0]
    if not len(begin):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = np.searchsorted(offsets, begin, side="right") - 1
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))) if begin[0] == 0 else (
        np.arange(len(data)) - np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.append(begin, len(data))))])
    )
    value = np.where(inside, _BYTE[data], np.uint64(0))
    value *= _powers(int(place.max()) + 1)[place]
    length = np.add.reduceat(inside.astype(np.uint64), begin)
    return _mix(np.add.reduceat(value, begin) + length), text


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, text = word_hashes(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        w = words[a:b]
        n = max(1, len(w) - width + 1) if len(w) else 0
        h = np.zeros(n, np.uint64)
        for k in range(min(width, len(w))):
            h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + w[k:k + n] + np.uint64(1))
        if 0 < len(w) < width:  # a short sequence is no shingle of a longer text
            h = _mix(h + np.uint64(len(w)))
        yield np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each coordinate the least value, different coordinates never alike."""
    least = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at:at + 4096][None, :] * _FACTOR[:, None]).min(axis=1))
    return _mix(least ^ _FACTOR)


def signed(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_shingles, set_key and sig of every text, written once."""
    rows = docs.select(row_key(docs).alias("row"), quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    alone = 100 // (100 - percent) if percent < 100 else 1 << 62  # smaller sets are similar to equal ones only

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sizes, keys, sigs = [], [], []
            for first, end, data, offsets in text_slices(batch, "text"):
                for s in shingle_sets(data, offsets, width):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s).view(np.int64) if len(s) >= alone - 1 else None)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_shingles", "set_key", "sig"],
            )

    return materialise(rows.mapInArrow(releasing(batches), f"row {ROW_KEY}, doc_id long, n_shingles long, set_key binary, sig array<long>"), "signed")


def classes(rows: DataFrame) -> DataFrame:
    """One row for each different set: node (a number), set_key, n, row (of a text that has it), least doc_id, sig."""
    groups = rows.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n"),
    )
    groups = materialise(groups.withColumn("node", F.monotonically_increasing_id()), "classes")
    sigs = rows.where("sig is not null").select("row", "sig")
    return materialise(sigs.join(groups.select("node", "row", "n"), "row").select("node", "row", "n", "sig"), "class-signatures"), groups


def posted(sigs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(value, node): the rarest values of each class that another class also has."""
    postings = sigs.select("node", F.explode("sig").alias("value"))
    counts = postings.groupBy("value").count().where("count > 1")
    common = postings.join(counts, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("v"))
    # At most COORDINATES values for each class.
    places = F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("v"))
    prefixes = common.where(places > 0).select("node", F.explode(F.slice("v", F.lit(1), places)).alias("p"))
    return materialise(prefixes.select(F.col("p.value").alias("value"), "node"), "postings")


def agreeing(one: str, other: str) -> Column:
    """In how many coordinates two signatures agree."""
    return F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda same: same))


def banded(sigs: DataFrame) -> DataFrame:
    """(key, node): the BANDS keys of each class."""
    keys = [F.xxhash64(F.lit(k), F.slice("sig", k * BAND + 1, BAND)) for k in range(BANDS)]
    return sigs.select("node", F.explode(F.array(*keys)).alias("key")).select("key", "node")


def candidates(sigs: DataFrame, postings: DataFrame, percent: int = PERCENT, matches: int = MATCHES, most: int = LIST) -> DataFrame:
    """(a, b) to be confirmed: pairs above the match threshold, and ties that lead from one class of
    such a pair to the other."""
    counts = materialise(postings.groupBy("value").agg(F.count("*").alias("members")).where("members > 1"), "lists")
    few = postings.join(counts.where(F.col("members") <= most).select("value"), "value").select(F.col("value").alias("key"), "node")
    crowded = postings.join(counts.where(F.col("members") > most).select("value"), "value").select("node").distinct()
    keys = materialise(banded(sigs.join(crowded, "node")), "bands")
    lists = materialise(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("least")).where("members > 1"), "lists")
    short = few.union(keys.join(lists.where(F.col("members") <= most).select("key"), "key").select("key", "node"))
    short = materialise(short.join(sigs.select("node", "n"), "node").select("key", "node", "n"), "short-lists")
    least = lists.where(F.col("members") > most).join(sigs.select(F.col("node").alias("least"), F.col("sig").alias("least_sig")), "least")
    met = keys.join(least, "key").join(sigs.select("node", "sig"), "node")
    met = materialise(met.select("key", "least", "node", (COORDINATES - agreeing("sig", "least_sig")).alias("apart")), "long-lists")
    within = COORDINATES - matches + NEAR
    ties = met.where((F.col("node") != F.col("least")) & (F.col("apart") <= within)).select(F.col("least").alias("a"), F.col("node").alias("b"))
    wide = met.where(F.col("apart") > within).select("key").distinct()
    rest = materialise(met.where(F.col("apart") > NEAR).join(wide, "key", "left_semi").select("key", "node"), "rests")
    left = short.select("key", F.col("node").alias("a"), F.col("n").alias("na"))
    right = short.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    one, other = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    alike = pairs.join(one, "a").join(other, "b").where(agreeing("sig_a", "sig_b") >= matches).select("a", "b")
    return reduce(DataFrame.union, [ties, blockwise(sigs, rest, matches)], alike)


def blockwise(sigs: DataFrame, lists: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(a, b): of the lists (key, node), pairs above the match threshold that span all such pairs."""
    parts = lists.groupBy("key").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = lists.join(parts, "key").select("key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    met = met.select("key", F.least("own", "k").alias("low"), F.greatest("own", "k").alias("high"), "node")

    def pairs(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_numpy()
        sig = group["sig"].combine_chunks().flatten().to_numpy().reshape(len(nodes), COORDINATES)
        agreed = np.zeros((len(nodes), len(nodes)), np.int16)
        for values in sig.T:
            agreed += values[:, None] == values[None, :]
        found = spanning(np.triu(agreed >= matches, 1))
        return pa.table({
            "a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64()),
        })

    return met.join(sigs.select("node", "sig"), "node").groupBy("key", "low", "high").applyInArrow(pairs, "a long, b long")


def blocks(family: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node and the groups (family, low, high) that its set must go to.

    `family` has node, root and n. Small families are one group. Others are cut into size
    classes and those into blocks of bounded shingles, by a hash; each block meets each block
    of its own and of the next size class.
    """
    totals = family.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    whole = (F.col("rows") <= FAMILY_ROWS) & (F.col("shingles") <= BLOCK_SHINGLES)
    sized = family.join(totals, "root").withColumn(
        "cls", F.when(whole, 0).otherwise(F.floor(F.log("n") / math.log(SIZE_BASE))).cast("int")
    )
    # A class holds as many blocks as its largest sets need.
    need = F.greatest(F.ceil(F.count("*") / FAMILY_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    counts = sized.groupBy("root", "cls").agg(need.alias("blocks"))
    # A family has no more classes than there are powers of SIZE_BASE.
    by_size = Window.partitionBy("root").orderBy("cls")
    counts = counts.withColumns({
        f"blocks_{name}": F.when(step("cls").over(by_size) == F.col("cls") + k, step("blocks").over(by_size))
        for name, step, k in (("above", F.lead, 1), ("below", F.lag, -1))
    })
    rows = sized.join(counts, ["root", "cls"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def label(cls: Column, block: Column) -> Column:
        return F.format_string("%d.%d", cls, block)

    def upto(n: str) -> Column:
        return F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    me = label(F.col("cls"), F.col("own"))
    inside = F.transform(upto("blocks"), lambda k: F.struct(
        label(F.col("cls"), F.least(k, "own")).alias("low"), label(F.col("cls"), F.greatest(k, "own")).alias("high")))
    up = F.transform(upto("blocks_above"), lambda k: F.struct(me.alias("low"), label(F.col("cls") + 1, k).alias("high")))
    down = F.transform(upto("blocks_below"), lambda k: F.struct(label(F.col("cls") - 1, k).alias("low"), me.alias("high")))
    return rows.withColumn("own", own).select("node", "root", "row", F.concat(inside, up, down).alias("groups"))


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs marked in a matrix that join all numbers which marked pairs join."""
    parent = list(range(len(linked)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def spanning_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of numbers that join all sets which links join, each of them a link."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    which = np.repeat(np.arange(n), sizes)
    vocabulary, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    which, column = which[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE_COLUMNS):
        a, b = np.searchsorted(column, [at, at + SLICE_COLUMNS])
        m = np.zeros((n, SLICE_COLUMNS), np.float32)
        m[which[a:b], column[a:b] - at] = 1
        both += m @ m.T
    meet = np.rint(both).astype(np.int64)
    return spanning(np.triu(100 * meet >= percent * (sizes[:, None] + sizes[None, :] - meet), 1))


def confirmed(docs: DataFrame, grouped: DataFrame, percent: int, width: int, text: str) -> DataFrame:
    """(a, b): links between the nodes of each group, enough to join what links join."""
    rows = docs.select(row_key(docs).alias("row"), quoted(text).alias("text"))
    # A row carries as many groups as its family has blocks to meet: those count, not the rows.
    meetings = grouped.agg(F.sum(F.size("groups"))).first()[0] or 0
    grouped = F.broadcast(grouped) if meetings <= BROADCAST_ROWS else grouped
    wanted = rows.join(grouped, "row").select("node", "root", "groups", "text")
    schema = wanted.drop("text").withColumn("shingles", F.array().cast("array<long>")).schema

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for first, end, data, offsets in text_slices(batch, "text"):
                part = batch.slice(first, end - first).drop_columns(["text"])
                sets = [s.view(np.int64) for s in shingle_sets(data, offsets, width)]
                yield part.append_column("shingles", pa.array(sets, pa.list_(pa.int64())))

    def links(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_numpy()
        shingles = group["shingles"].combine_chunks()
        values = shingles.flatten().to_numpy().view(np.uint64)
        lengths = np.diff(shingles.offsets.to_numpy())
        sets = np.split(values, np.cumsum(lengths)[:-1])
        pairs = spanning_links(sets, percent)
        return pa.table({
            "a": pa.array([nodes[i] for i, _ in pairs], pa.int64()), "b": pa.array([nodes[j] for _, j in pairs], pa.int64()),
        })

    sets = wanted.mapInArrow(releasing(batches), schema).select("node", "root", "shingles", F.explode("groups").alias("g"))
    return sets.select("node", "root", "g.low", "g.high", "shingles").groupBy("root", "low", "high").applyInArrow(links, "a long, b long")


@in_small_batches
def named_components(docs: DataFrame, percent: int, width: int, doc_id: str, text: str) -> DataFrame:
    """One row per document of a `stored` table: row, doc_id, n_shingles, root (a number of its
    component, null without a word) and component_id."""
    rows = signed(docs, percent, width, doc_id, text)
    sigs, groups = classes(rows)
    postings = posted(sigs)
    families = components(candidates(sigs, postings, percent))
    family = materialise(families.join(sigs.select("node", "row", "n"), "node"), "families")
    grouped = materialise(blocks(family, percent), "blocks")
    linked = components(confirmed(docs, grouped, percent, width, text))
    named = groups.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # Sets that no other set is linked with keep their own least doc_id.
    member = materialise(
        named.join(names.where(F.col("component_id").isNotNull()), "root", "left").select("set_key", "root", "component_id"), "members"
    )
    return rows.join(member, "set_key", "left").select("row", "doc_id", "n_shingles", "root", "component_id")


def near_dedup(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept,
    and row, the document's place in the table."""
    return named_components(stored(docs), percent, width, doc_id, text).select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"), "row",
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the one with the least doc_id, null the last,
    and of several such rows the first of the table. Rows without a word stay."""
    docs, row = stored(docs), fresh(docs, "row")
    found = named_components(docs, percent, width, doc_id, text).where("root is not null")
    found = materialise(found.select("doc_id", "root", F.col("row").alias("place")), "judged")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "place"))["place"].alias("place")
    first = found.groupBy("root").agg(least).select("place")
    dropped = materialise(found.join(first, "place", "left_anti").select(F.col("place").alias(row)), "dropped")
    return docs.withColumn(row, row_key(docs)).join(small(dropped), row, "left_anti").drop(row)
