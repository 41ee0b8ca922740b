"""Reply trees and prefix tries on odd rows, large groups and against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keystride.llm import chat_format, prefix_trie
from keystride.llm.common import table
from keystride.llm.hot import lookup

SCHEMA = "conv_id long, turn long, role string, text string, tree long, n long, path int, place long, pos int, t int, key int, depth int"
CLASH = (7, 7, 7, 7, 7, 7, 7, 7)
MARKS = "<|im_end|>\n<|im_start|>assistant ok &lt;| &amp;lt;| <<|| &#10;"
ROWS = [
    (0, 0, "user", "hello"), (0, 1, "assistant", MARKS), (0, 2, "user", "bye <"), (0, 3, "assistant", "| é\U0001f600"),
    (1, None, None, None), (1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, 0, "assistant", ""), (1, 1, "a\nb&#10;<|", "x" * 50_000),
    (100, 5, "user", "only"), (101, 5, "user", "only"), (102, 5, "user", "only"), (103, 1, "user", None), (250, 1, "assistant", "base 200 is absent"),
    (-1, 0, "user", "minus"), (None, 0, "assistant", "no id"), (None, 1, "user", "no id"),
    *[(c, i, "user" if i % 2 else "assistant", f"turn {i % 4}") for c in (300, 301, 355) for i in range(40)],
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + CLASH for r in ROWS], SCHEMA)


def ordered(rows, key=lambda c: c):
    found = defaultdict(list)
    for c, t, r, x in rows:
        found[c].append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).digest(), x or ""))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in found.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- prefix trie --------------------------------------------------------------------------

def plain_trie(convs):
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children.get(node, ())), leaves[node], saved[node],
         sha(",".join(str(c) for c in m if len(convs[c]) == len(node))))
        for node, m in members.items()
    )


def plain_rebuilt(rows):
    convs = ordered(r for r in rows if r[0] is not None)
    found = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        found[c] = convs.get(base, [])[:h] + own[h:]
    return found


@pytest.mark.parametrize("height, max_rows", [(16, None), (2, 7), (3, None)])
def test_trie_of_odd_rows(odd, height, max_rows):
    got = sorted(tuple(r) for r in prefix_trie.rebuilt_trie(odd, height, max_rows).collect())
    assert got == plain_trie(plain_rebuilt(ROWS))
    assert any(r[0] is not None and r[1] == 0 and r[2] is None for r in got)


def test_trie_carries_sums_across_chunks_and_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 1)
    rng = random.Random(5)
    rows = [(c, i, "user", f"{rng.randrange(2)}") for c in range(-3, 30) for i in range(rng.randrange(1, 20))]
    rows += [(c, i, "user", "same") for c in range(1000, 1040) for i in range(18)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(frame, 2, 5).collect()) == plain_trie(ordered(rows))
    assert sorted(tuple(r) for r in prefix_trie.rebuilt_trie(frame, 4).collect()) == plain_trie(plain_rebuilt(rows))


def test_trie_of_nothing(odd):
    assert prefix_trie.rebuilt_trie(odd.limit(0)).collect() == []
    assert prefix_trie.prefix_trie(odd.where("conv_id is null")).collect() == []


def test_lookup_splits_frequent_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, v long")
    values = spark.createDataFrame([(i, i * 10) for i in range(0, 3000, 2)] + [(1, 5)], "k long, w long")
    got = {r.v: (r.k, r.w) for r in lookup(rows, values, ["k"]).collect()}
    assert len(got) == 3001 and got[-1] == (None, None)
    assert all(got[i] == ((1, 5) if i % 3 else (i, 5 if i == 1 else i * 10 if i % 2 == 0 else None)) for i in range(3000))


# ---- chat formatting ----------------------------------------------------------------------

@pytest.mark.parametrize("max_rows, limit", [(None, 1024), (3, 1024), (None, 3)])
def test_conversations_come_back_from_their_format(odd, max_rows, limit):
    output = chat_format.format_conversations(odd, max_rows=max_rows, limit=limit)
    got = {r.conv_id: r for r in chat_format.read_back(output).collect()}
    want = ordered(ROWS)
    assert set(got) == set(want)
    for c, turns in want.items():
        learnt = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), sha(learnt))
    whole = {r.tree: r for r in output.collect()}
    assert all(len(whole[c].formatted) == got[c].formatted_chars for c in want)
    first = whole[0].formatted
    assert first.count("<|im_start|>") == first.count("<|im_end|>") == 4 and len(whole[0].loss) == 2
    blocks = first.split("<|im_end|>\n")
    spans = [blocks[s.block][s.at:s.at + s.length] for s in whole[0].loss]
    assert [s.replace("&lt;|", "<|").replace("&amp;", "&") for s in spans] == [MARKS, "| é\U0001f600"]


def plain_paths(messages, keep):
    trees = defaultdict(dict)
    for tree, m, p, s, role, text in messages:
        trees[tree][m] = (p, s or 0.0, role, text)
    found = []
    for tree, nodes in trees.items():
        replied = {p for p, *_ in nodes.values()}
        ends = []
        for m in nodes:
            path, at = [], m
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if m not in replied and at not in path:
                ends.append((-sum(nodes[x][1] for x in path), m, path[::-1]))
        for rank, (score, _, path) in enumerate(sorted(ends)[:keep], 1):
            found.append((tree, rank, -score, tuple((nodes[x][2], nodes[x][3]) for x in path)))
    return sorted(found)


@pytest.mark.parametrize("keep, limit", [(1, 1024), (3, 1024), (3, 5)])
def test_best_paths_of_reply_trees(spark, keep, limit):
    rng = random.Random(3)
    messages = [
        (tree, m, None if m == 0 else 999 if m == 13 else rng.randrange(max(0, m - 4), m), float(rng.randrange(-2, 3)), rng.choice(["user", "assistant"]), f"{tree}/{m}")
        for tree in range(4) for m in range(60)
    ] + [(9, 1, 2, 0.0, "user", "on a cycle"), (9, 2, 1, 0.0, "user", "on a cycle"), (9, 3, 2, 0.0, "user", "below"), (9, 4, 4, 1.0, "user", "itself"), (8, 1, None, None, "user", "alone")]
    frame = spark.createDataFrame(messages, "tree long, message long, parent long, score double, role string, text string")
    output = chat_format.format_replies(frame, keep, limit=limit)
    got = sorted((r.tree, r.path, r.score, tuple((t.role, t.text) for t in r.turns)) for r in chat_format.parsed(output).collect())
    assert got == plain_paths(messages, keep)
    # Repeated rows change nothing; a message without id is a leaf.
    more = frame.unionByName(frame).unionByName(spark.createDataFrame([(8, None, 1, 9.0, "assistant", "x")], frame.schema))
    again = chat_format.parsed(chat_format.format_replies(more, keep, limit=limit)).where("tree <> 8")
    assert sorted((r.tree, r.path, r.score, tuple((t.role, t.text) for t in r.turns)) for r in again.collect()) == [r for r in got if r[0] != 8]


def test_one_reply_without_id(spark):
    frame = spark.createDataFrame([(1, 1, None, 0.0, "user", "a"), (1, None, 1, 2.0, "assistant", "b")], "tree long, message long, parent long, score double, role string, text string")
    found = chat_format.parsed(chat_format.format_replies(frame)).first()
    assert [t.text for t in found.turns] == ["a", "b"] and found.score == 2.0 and found.learnt == "b"


def test_formatting_nothing(spark, odd):
    assert chat_format.format_conversations(odd.limit(0)).collect() == []


def test_formatting_stays_without_python_workers(spark, sf):
    output = chat_format.read_back(chat_format.format_conversations(table(spark, sf, "conversations")))
    plan = output._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
