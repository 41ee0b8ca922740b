"""The trie of conversation prefixes, rolled up in depth bands.

A node is a distinct sequence of a conversation's first d turns (role and text). Its key is a
digest of d and of the running sums of one digest for each turn, which holds the turn's place; sums
need no chain, so a conversation of any length is cut into chunks and summed in parallel, and a
node's parent follows by taking its last turn's digest away. Its least member stands for it: the pair
(conv_id, depth) names a node, and that conversation's own rows lead to all its ancestors.

Sums over subtrees go up in bands of `height` levels. A node explodes only to its ancestors within its band (one
path's nodes are added up first, so a path emits one row for each level). The totals of the bands' top
nodes form a trie of their own, `height` times less deep, which is rolled up in the same way; the finished
totals go back into the band above. Depth D takes log D / log height rounds, each row explodes to `height` at most.

Turns are ordered by `turn` (null first), ties by role and the text's MD5; rows equal in all of these are turns of
their own. Null role or text is empty. Rows without conv_id belong to no conversation. An empty table has no
root and gives an empty result. Other columns play no part. Running sums hold up to 2^31 turns of a conversation.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import Batches, quoted, row_key, stored
from keystride.llm.hot import lookup
from keystride.operators.slicing import per_group, position
from keystride.session import materialise

HEIGHT = 16
#: Turns of one conversation that are summed in one task.
CHUNK = 1 << 16
#: Numbers of 32 bits that a turn's digest is cut into; their sums are the key.
PARTS = 5
#: A list of this many conversation numbers at most is one row.
ID_BITS = 8
SUMS = [f"s{i}" for i in range(PARTS)]
PARTS_OF = [f"p{i}" for i in range(PARTS)]


def turn_rows(conversations: DataFrame, max_rows: int | None = None) -> DataFrame:
    """conv_id, place (from 0), content (digest of role and text) and chars (of the text), written once."""
    conversations = stored(conversations)
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(
        quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").alias("t"),
        F.struct(role.alias("role"), F.unhex(F.md5(text)).alias("text"), row_key(conversations).alias("row")).alias("pos"),
        F.unhex(content).alias("content"), F.char_length(text).cast("long").alias("chars"),
    )
    placed = per_group(rows, lambda part: position(part, "place", ["conv_id"]), "conv_id", max_rows)
    return materialise(placed.select("conv_id", "place", "content", "chars"), "turns")


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from its hundred's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with `depth` (from 1) of the rebuilt conversations, and their lengths (conv_id, length).

    The first `borrowed` turns of a conversation come from conversation c - c % 100, the others are its own.
    """
    sizes = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    number = F.col("conv_id")
    plan = sizes.withColumns({"h": borrowed(number), "base": number - number % 100})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = plan.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = materialise(plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")

    # A long conversation's turns meet its plan chunk by chunk.
    chunks = plan.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0), F.expr(f"int((n - 1) div {CHUNK})"))).alias("chunk"))
    own = (
        turns.withColumn("chunk", F.expr(f"int(place div {CHUNK})")).join(chunks, ["conv_id", "chunk"])
        .where(F.col("place") >= F.col("h"))
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "content", "chars")
    )
    first = turns.where("place < 5").withColumnRenamed("conv_id", "base")
    taken = plan.select("conv_id", "base", "taken").join(first, "base").where(F.col("place") < F.col("taken"))
    rows = own.unionByName(taken.select("conv_id", (F.col("place") + 1).alias("depth"), "content", "chars"))
    return rows, plan.select("conv_id", "length")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[c.cast("string") for c in (depth, *sums)])))


def path_rows(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent and chars of each prefix of each conversation, from depth 0; written once."""
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.hex("content")), 256)
    part = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(PARTS_OF[i]) for i in range(PARTS)]
    rows = turns.withColumns({"digest": digest, "chunk": F.expr(f"(depth - 1) div {CHUNK}")}).select(
        "conv_id", "depth", "chunk", "chars", *part
    )
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several chunks have anything to carry.
    carried = (
        rows.groupBy("conv_id", "chunk").agg(*[F.sum(p).alias(s) for p, s in zip(PARTS_OF, SUMS)])
        .select("conv_id", "chunk", *[F.sum(s).over(before).alias(s) for s in SUMS]).where("chunk > 0")
    )
    rows = rows.withColumns({f"run{i}": F.sum(p).over(within) for i, p in enumerate(PARTS_OF)})
    rows = rows.join(carried, ["conv_id", "chunk"], "left").withColumns(
        {f"run{i}": F.col(f"run{i}") + F.coalesce(s, F.lit(0)) for i, s in enumerate(SUMS)}
    )
    runs = [F.col(f"run{i}") for i in range(PARTS)]
    zero = _key(F.lit(0), [F.lit(0)] * PARTS)
    roots = lengths.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars")
    )
    return materialise(roots.unionByName(rows.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), _key(F.col("depth"), runs).alias("key"),
        _key(F.col("depth") - 1, [r - F.col(p) for r, p in zip(runs, PARTS_OF)]).alias("parent"), "chars",
    )), "paths")


def subtree_sums(paths: DataFrame, names: list[str], height: int = HEIGHT) -> DataFrame:
    """key and the sums of `names` over the subtree of each node.

    paths, a written table: conv_id, depth, key for the prefixes of conversations, without gaps, `own` where the
    conversation stands for the node, and there `names`, else zeros.
    """
    deepest = paths.agg(F.max("depth")).first()[0]
    if deepest is None:
        return paths.select("key", *names)
    bands = materialise(
        paths.groupBy("conv_id", F.expr(f"depth div {height}").alias("band"))
        .agg(F.array_sort(F.collect_list(F.struct("depth", "key", *names))).alias("nodes")), "bands",
    )

    def added(name: str, first: Column | int = 1) -> Column:
        return F.aggregate(F.slice("nodes", first, height), F.lit(0).cast("long"), lambda total, x: total + x[name])

    carried = bands.select("conv_id", "band", *[F.lit(0).cast("long").alias(f"below_{n}") for n in names]).limit(0)
    if deepest >= height:
        totals = bands.select(F.col("nodes")[0]["key"].alias("key"), *[added(n).alias(n) for n in names])
        totals = totals.groupBy("key").agg(*[F.sum(n).alias(n) for n in names])
        tops = paths.where(f"depth % {height} = 0").select("conv_id", F.expr(f"depth div {height}").alias("depth"), "key", "own")
        coarse = materialise(
            tops.where("own").join(totals, "key")
            .unionByName(tops.where("not own").select("*", *[F.lit(0).cast("long").alias(n) for n in names])), "tops",
        )
        finished = subtree_sums(coarse, names, height)
        carried = coarse.where("own and depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), "key").join(
            finished, "key"
        ).select("conv_id", "band", *[F.col(n).alias(f"below_{n}") for n in names])

    summed = bands.join(carried, ["conv_id", "band"], "left").select(F.explode(F.transform("nodes", lambda x, i: F.struct(
        x["key"].alias("key"), *[(added(n, i + 1) + F.coalesce(f"below_{n}", F.lit(0))).alias(n) for n in names]
    ))).alias("x")).select("x.*")
    some = [F.col(n) != 0 for n in names]
    any_of = some[0]
    for one in some[1:]:
        any_of = any_of | one
    return materialise(summed.where(any_of).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]), "sums")


def _digest_lists(found: Batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lists, which come in order, joined by commas; one list is held at a time."""
    key, digest = None, None

    def out(pairs: list[tuple[bytes, str]]) -> pa.RecordBatch:
        keys, sums = zip(*pairs) if pairs else ((), ())
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], ["key", "ends_sha256"])

    for batch in found:
        done = []
        for name, ids in zip(batch.column("key").to_pylist(), batch.column("ids")):
            if name != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
        yield out(done)
    if digest is not None:
        yield out([(key, digest.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """key and the digest of the ascending conversation numbers that end there.

    Numbers are ordered and written in lists of at most 2^ID_BITS, in all tasks; the task of a node
    where very many conversations end only streams the finished lists through the digest.
    """
    lists = ends.groupBy("key", F.shiftright("conv_id", ID_BITS).alias("run")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    ordered = lists.repartition("key").sortWithinPartitions("key", "run").select("key", "ids")
    return ordered.mapInArrow(_digest_lists, "key binary, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row for each node of the trie of `turns` (conv_id, depth from 1, content, chars).

    lengths: conv_id and the number of turns of every conversation, also of those without any.
    """
    paths = path_rows(turns, lengths)
    nodes = materialise(
        paths.groupBy("key", "depth", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes"
    )
    children = nodes.dropna(subset=["parent"]).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    values = nodes.select(
        "conv_id", "depth", F.lit(True).alias("own"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    names = ["n_leaves", "saved_tokens"]
    valued = materialise(paths.select("conv_id", "depth", "key").join(values, ["conv_id", "depth"], "left").fillna(0, names).fillna(False, ["own"]), "valued")
    sums = subtree_sums(valued, names, height)
    # A conversation ends where its depth is its length; the two tables meet on both, so no key is frequent.
    ends = end_digests(paths.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("key", "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = lookup(nodes, parents, ["parent"])
    return found.join(sums, "key").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, height: int = HEIGHT, max_rows: int | None = None) -> DataFrame:
    """The trie of the table's own conversations."""
    turns = turn_rows(conversations, max_rows)
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    return trie(turns.withColumn("depth", F.col("place") + 1), lengths, height)


def rebuilt_trie(conversations: DataFrame, height: int = HEIGHT, max_rows: int | None = None) -> DataFrame:
    """The trie of the conversations with borrowed beginnings (see `rebuilt`)."""
    return trie(*rebuilt(turn_rows(conversations, max_rows)), height)
