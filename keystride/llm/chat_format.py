"""Reply trees as conversations: paths from root to leaf, ranked, the best ones formatted.

Only narrow rows take part until the paths are chosen. Every message first points at its parent; iterative
self-joins double the pointers' reach, adding up scores and steps on the way, until all pointers have passed
a root: log2(depth) rounds. Leaves are ranked by their path's score, and the chosen ones go back along the stored
pointers, longest first, so that every round doubles what is known of a path. Texts are shuffled once, by
tree, where a path picks its messages by their numbers; the few trees too large for one row send only the
messages of chosen paths, by (tree, number).

A formatted conversation is one string of blocks, `<|im_start|>role`, newline, text, `<|im_end|>`, newline. In texts and roles `&` is
written `&amp;` and `<|` as `&lt;|` (in roles also a newline as `&#10;`), which can be undone, so no text holds a mark.
`loss` lists the spans to learn from: block number, place in the block and length in code points, one for each assistant text.

Null role or text is empty, a null score 0. A message whose parent is null or absent is a root. Of rows with one id in a tree
the first by role and MD5 of the text is the message, the others are left out; a message without id has no replies. Messages on a cycle of
replies, or below one, have no root and are on no path. Rows without a tree form one tree of their own. Ties of scores go to the earlier
message. An empty table gives an empty result; other columns play no part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystride.llm.common import quoted
from keystride.llm.hot import lookup
from keystride.operators.slicing import per_group, position
from keystride.session import materialise

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"
#: Messages of a tree that may be one row; at most 1/MOST_LARGE of all rows are beyond it in one tree.
TREE_MESSAGES = 1024
MOST_LARGE = 1_000_000
#: Parts that a tree's leaves are ranked in before the best of each part meet.
SALTS = 64


def _text(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def _rows(messages: DataFrame, tree: str, order: str, *more: Column) -> DataFrame:
    """tree (a struct, so that a null is a tree too), t and pos (a message's place in order) and `more`."""
    return messages.select(
        F.struct(quoted(tree).alias("id")).alias("tree"), quoted(order).alias("t"),
        F.struct(_text("role").alias("role"), F.unhex(F.md5(_text("text"))).alias("text")).alias("pos"), *more,
    )


def _numbered(rows: DataFrame, max_rows: int | None) -> DataFrame:
    """Rows with their number n in the tree, from 0, by order, role and MD5 of the text."""
    return per_group(rows, lambda part: position(part, "n", ["tree"]), "tree", max_rows)


def chains(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", max_rows: int | None = None) -> DataFrame:
    """Nodes of conversations, each turn being a reply to the one before it (null turn first)."""
    nodes = _numbered(_rows(conversations, conv_id, turn), max_rows)
    parent = F.when(F.col("n") > 0, F.col("n") - 1)
    return materialise(nodes.select("tree", "n", "t", "pos", parent.alias("parent"), F.lit(0.0).alias("score")), "nodes")


def replies(
    messages: DataFrame, tree: str = "tree", message: str = "message", parent: str = "parent", score: str = "score",
    max_rows: int | None = None,
) -> DataFrame:
    """Nodes of reply trees: every message names its parent."""
    extra = quoted(parent).alias("reply_to"), F.coalesce(quoted(score).cast("double"), F.lit(0.0)).alias("score")
    nodes = materialise(_numbered(_rows(messages, tree, message, *extra), max_rows), "numbered")
    first = materialise(nodes.dropna(subset=["t"]).groupBy("tree", "t").agg(F.min("n").alias("first")), "first")
    kept = nodes.join(first, ["tree", "t"], "left").where(F.col("t").isNull() | (F.col("n") == F.col("first"))).drop("first")
    known = first.withColumnsRenamed({"t": "reply_to", "first": "parent"})
    return lookup(materialise(kept, "kept"), known, ["tree", "reply_to"]).select("tree", "n", "t", "pos", "parent", "score")


def _reach(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message with its path's score and steps from the root, and the pointers (tree, n, parent) of each round."""
    now = materialise(nodes.select("tree", "n", "parent", "score", F.lit(1).cast("long").alias("steps")), "reach")
    rounds, waiting = [], None
    while True:
        open_rows = now.where("parent is not null")
        left = open_rows.count()
        # Whatever can reach a root gets nearer in every round; the rest lies on cycles.
        if left in (0, waiting):
            return now.where("parent is null").select("tree", "n", "score", "steps"), rounds
        rounds.append(open_rows.select("tree", "n", "parent"))
        waiting = left
        ahead = now.select("tree", F.col("n").alias("parent"), F.col("parent").alias("beyond"), F.col("score").alias("more"), F.col("steps").alias("further"))
        moved = open_rows.join(ahead, ["tree", "parent"]).select(
            "tree", "n", F.col("beyond").alias("parent"), (F.col("score") + F.col("more")).alias("score"), (F.col("steps") + F.col("further")).alias("steps")
        )
        now = materialise(moved.unionByName(now.where("parent is null")), "reach")


def _best(leaves: DataFrame, keep: int) -> DataFrame:
    """The `keep` best leaves of each tree with their rank, from 1; a tree's leaves are ranked in parts first."""

    def first_of(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "n")
        return rows.withColumn("path", F.row_number().over(order)).where(F.col("path") <= keep)

    parts = first_of(leaves.withColumn("part", F.col("n") % SALTS), "tree", "part")
    return first_of(parts.drop("path", "part"), "tree")


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, path, score, place, n) of the messages on the `keep` best paths of each tree, written once."""
    reached, rounds = _reach(nodes)
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("n")).distinct()
    leaves = reached.join(inner, ["tree", "n"], "left_anti")
    found = materialise(
        _best(leaves, keep).select("tree", "path", "score", (F.col("steps") - 1).alias("place"), "n"), "paths"
    )
    for power in range(len(rounds) - 1, -1, -1):
        # At most `keep` rows of `found` name one message.
        up = found.join(rounds[power], ["tree", "n"]).select(
            "tree", "path", "score", (F.col("place") - (1 << power)).alias("place"), F.col("parent").alias("n")
        )
        found = materialise(found.unionByName(up), "paths")
    return found


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&lt;|"), F.lit("<|")), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def path_texts(messages: DataFrame, nodes: DataFrame, members: DataFrame, tree: str, order: str, limit: int = TREE_MESSAGES) -> DataFrame:
    """tree, path, score and turns, an array of (role, text) in order."""
    texts = _rows(messages, tree, order, _text("text").alias("text"))
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("size"), F.max("n").alias("last"))
    most = max(limit, nodes.count() // MOST_LARGE)
    # At most MOST_LARGE trees are beyond this size.
    large = materialise(sizes.where(F.greatest("size", F.col("last") + 1) > most).select("tree"), "large")
    small_members = members.join(F.broadcast(large), "tree", "left_anti")
    steps = small_members.groupBy("tree", "path", "score").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("steps"))
    whole = texts.join(F.broadcast(large), "tree", "left_anti").groupBy("tree").agg(
        F.array_sort(F.collect_list(F.struct("t", "pos", "text"))).alias("messages")
    )
    chosen = F.transform("steps", lambda s: F.get("messages", s["n"].cast("int")))
    ordinary = whole.join(steps.hint("merge"), "tree").select("tree", "path", "score", F.transform(
        chosen, lambda m: F.struct(m["pos"]["role"].alias("role"), m["text"].alias("text"))
    ).alias("turns"))

    named = members.join(F.broadcast(large), "tree").join(nodes.select("tree", "n", "t", "pos"), ["tree", "n"])
    # Rows equal in order, role and MD5 have one text.
    one = texts.join(F.broadcast(large), "tree").groupBy("tree", "t", "pos").agg(F.max("text").alias("text"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ("tree", "t", "pos")]
    long_paths = named.alias("m").join(one.alias("x"), same).groupBy("m.tree", "path", "score").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("m.pos.role").alias("role"), "x.text"))).alias("turns")
    ).select("tree", "path", "score", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return ordinary.unionByName(long_paths)


def formatted(paths_with_texts: DataFrame) -> DataFrame:
    """tree, path, score, formatted and loss."""
    blocks = paths_with_texts.withColumn("turns", F.transform("turns", lambda t: F.struct(
        (t["role"] == LEARNT).alias("learnt"), escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text")
    )))
    spans = F.transform("turns", lambda t, i: F.struct(
        i.alias("block"), (F.char_length(t["role"]) + len(START) + 1).alias("at"), F.char_length(t["text"]).alias("length"), t["learnt"].alias("learnt")
    ))
    spans = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: s.dropFields("learnt"))
    block = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END)))
    return blocks.select(F.col("tree.id").alias("tree"), "path", "score", F.array_join(block, "").alias("formatted"), spans.alias("loss"))


def parsed(output: DataFrame) -> DataFrame:
    """`formatted` output with `turns`, an array of (role, text), and `learnt`, the text under the loss mask, read from it."""
    blocks = output.withColumn("blocks", F.split("formatted", "<\\|im_end\\|>\n"))
    blocks = blocks.withColumn("blocks", F.slice("blocks", 1, F.size("blocks") - 1)).withColumn("n_turns", F.size("blocks").cast("long"))
    body = F.transform("blocks", lambda b: F.substring(b, len(START) + 1, 2**31 - 1))
    role = F.transform(body, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), b.alias("body")))
    turns = F.transform(role, lambda r: F.struct(
        unescaped_role(r["role"]).alias("role"), unescaped(F.substring(r["body"], F.char_length(r["role"]) + 2, F.lit(2**31 - 1))).alias("text")
    ))
    learnt = F.transform("loss", lambda s: unescaped(F.substring(F.get("blocks", s["block"]), s["at"] + 1, s["length"])))
    return blocks.select("*", turns.alias("turns"), F.array_join(learnt, "").alias("learnt")).drop("blocks")


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", max_rows: int | None = None, limit: int = TREE_MESSAGES) -> DataFrame:
    """tree (the conv_id), path, score, formatted, loss: one row for each conversation."""
    nodes = chains(conversations, conv_id, turn, max_rows)
    return formatted(path_texts(conversations, nodes, paths(nodes), conv_id, turn, limit))


def format_replies(
    messages: DataFrame, keep: int = 1, tree: str = "tree", message: str = "message", parent: str = "parent", score: str = "score",
    max_rows: int | None = None, limit: int = TREE_MESSAGES,
) -> DataFrame:
    """The `keep` best paths of each reply tree, one row for each."""
    nodes = materialise(replies(messages, tree, message, parent, score, max_rows), "nodes")
    return formatted(path_texts(messages, nodes, paths(nodes, keep), tree, message, limit))


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the formatted text and its mask."""
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parsed(output).select(
        F.col("tree").alias("conv_id"), "n_turns", F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
