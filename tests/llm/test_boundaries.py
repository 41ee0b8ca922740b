"""Boundary cells, long posting lists, rules from parsed patterns, bounded fingerprints, the language
model against a plain loop, and exact quantiles."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystride.llm import components, fingerprint, mixing, near_dedup, packing, quality, url_filter
from keystride.llm.common import ROW_KEY, stored, table
from keystride.session import materialise


# ---- mixing -------------------------------------------------------------------------------

@pytest.mark.parametrize("ids, texts", [("null", "one"), ("null", "own"), ("same", "one"), ("same", "own")])
def test_targets_are_met_by_rows_that_share_an_id(spark, ids, texts):
    source = F.element_at(F.lit(["a", "b", "c"]), (F.least(F.floor(F.sqrt(F.col("id") % 7)), F.lit(2)) + 1).cast("int"))
    text = F.lit("three words here") if texts == "one" else F.concat(F.lit("words of "), F.col("id").cast("string"))
    name = F.lit(None).cast("long") if ids == "null" else F.lit(7).cast("long")
    docs = spark.range(1200).select(name.alias("doc_id"), text.alias("text"), source.alias("source"), F.lit(1).alias("cell"))
    docs = materialise(docs, "same-ids")
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == 1200 and (rows["taken"] <= 2 * rows["size"]).all()
    sums = rows.groupby(["target", "source_size"], as_index=False)["taken"].sum()
    assert (abs(sums["taken"] - sums["target"]) <= 3).all(), sums
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.words())).first()[0] == rows["taken"].sum()


# ---- near duplicates ----------------------------------------------------------------------

def zipf_texts(n, seed=3, words=40, vocabulary=400):
    draw = np.random.default_rng(seed)
    weights = 1 / np.arange(1, vocabulary + 1)
    found = draw.choice(vocabulary, (n, words), p=weights / weights.sum())
    return [" ".join(f"w{x}" for x in row) for row in found.tolist()]


def linked(texts, percent=80):
    """Components by brute force over the pairs that share a shingle."""
    sets = [{*zip(t.split(), t.split()[1:])} for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            held[shingle].append(i)
    for i, s in enumerate(sets):
        meets = Counter(j for shingle in s for j in held[shingle] if j > i)
        for j, both in meets.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_long_lists_lose_no_link(spark):
    """Few words, so that lists are long, with near copies among them, copies of copies, and a large group."""
    draw = random.Random(5)
    texts = zipf_texts(600, vocabulary=60)

    def edited(text, n):
        words = text.split()
        for _ in range(n):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10 ** 6)}"
        return " ".join(words)

    texts += [edited(t, 1) for t in texts[:80]] + [edited(t, 2) for t in texts[:40]]
    texts += [edited(texts[0], 1) for _ in range(150)]
    docs = materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "zipf")
    rows = near_dedup.signed(stored(docs))
    sigs, _ = near_dedup.classes(rows)
    postings = near_dedup.posted(sigs)
    expected = linked(texts)
    for most in (2, 8):
        pairs = near_dedup.candidates(sigs, postings, most=most)
        roots = {r.node: r.root for r in near_dedup.components(pairs).collect()}
        place = {r.node: r.doc_id for r in sigs.join(rows.select("row", "doc_id"), "row").collect()}
        root = {place[n]: r for n, r in roots.items()}
        for i, r in enumerate(expected):
            if i in root and r in root:
                assert root[i] == root[r]
            else:
                assert i == r or texts[i] == texts[r]
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_long_lists_tie_no_unlike_texts(spark):
    docs = materialise(spark.createDataFrame(list(enumerate(zipf_texts(3000, vocabulary=60))), "doc_id long, text string"), "zipf")
    sigs, _ = near_dedup.classes(near_dedup.signed(stored(docs)))
    postings = near_dedup.posted(sigs)
    assert postings.groupBy("value").count().where("count > 8").count() > 100
    pairs = materialise(near_dedup.candidates(sigs, postings, most=8), "pairs")
    one, other = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    agreed = pairs.join(one, "a").join(other, "b").select(near_dedup.agreeing("sig_a", "sig_b").alias("n"))
    assert agreed.count() == pairs.count() and agreed.where(f"n < {near_dedup.MATCHES - near_dedup.NEAR}").isEmpty()
    assert near_dedup.components(pairs).groupBy("root").count().agg(F.max("count")).first()[0] < 100


def test_rows_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Near copies of one text, most of them neither close to each other nor far: what candidates write."""

    def written(n):
        draw, rows = random.Random(9), []
        base = [f"w{i}" for i in range(120)]
        texts = [" ".join(f"x{draw.randrange(10 ** 9)}" if draw.random() < 0.09 else w for w in base) for _ in range(n)]
        docs = materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "copies")
        sigs, _ = near_dedup.classes(near_dedup.signed(stored(docs)))
        postings = near_dedup.posted(sigs)

        def counted(df, label):
            found = materialise(df, label)
            rows.append(found.count())
            return found

        with monkeypatch.context() as m:
            m.setattr(near_dedup, "materialise", counted)
            near_dedup.candidates(sigs, postings).count()
        return sum(rows)

    small, large = written(150), written(600)
    assert large <= 5 * small and large <= 100 * 600


def test_finished_components_take_no_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components, "materialise", lambda df, label: tables.append(label) or materialise(df, label))
    edges = [(1, 5), (9, 1), (2, 3), (2, 2), (4, 2), (3, 2)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 5: 1, 9: 1, 2: 2, 3: 2, 4: 2} and tables == ["edges", "components"]
    for edges, done in (([(1, 2), (1, 3)], True), ([(1, 2), (2, 3)], False), ([(1, 3), (2, 3)], False), ([], True)):
        assert components.stars(spark.createDataFrame(edges, "a long, b long")) == done


def test_blocks_meet_their_neighbours_with_few_scans(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FAMILY_ROWS", 5)
    draw = np.random.default_rng(5)
    rows = [(i, i % 3, (0, i), int(draw.integers(30, 90) if i % 3 else draw.choice([20, 90, 140]))) for i in range(120)] + [(500, 9, (0, 500), 7)]
    family = materialise(spark.createDataFrame(rows, f"node long, root long, row {ROW_KEY}, n long"), "family")
    groups = near_dedup.blocks(family)
    found = {r.node: {(r.root, g.low, g.high) for g in r.groups} for r in groups.collect()}
    assert set(found) == {node for node, *_ in rows}
    cls = {node: math.floor(math.log(n) / math.log(near_dedup.SIZE_BASE)) for node, _, _, n in rows}
    for a, root, *_ in rows:
        for b, other, *_ in rows:
            meet = root == other and abs(cls[a] - cls[b]) <= 1
            assert bool(found[a] & found[b]) == meet
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 4


def test_blocks_of_wide_lists_lose_no_pair(spark, monkeypatch):
    """A list of more blocks than one, of which no class is near the least: all pairs above the threshold meet."""
    monkeypatch.setattr(near_dedup, "LIST_ROWS", 7)
    draw = np.random.default_rng(4)
    sigs = [draw.integers(0, 1 << 60, near_dedup.COORDINATES) for _ in range(30)]
    sigs += [np.where(np.arange(near_dedup.COORDINATES) < draw.integers(30, 50), s, draw.integers(0, 1 << 60, near_dedup.COORDINATES)) for s in sigs]
    agreed = [[int((a == b).sum()) for b in sigs] for a in sigs]
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if agreed[i][j] >= near_dedup.MATCHES}
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sigs)], "node long, sig array<long>")
    found = near_dedup.blockwise(frame, frame.selectExpr("1L as key", "node")).collect()
    assert expected and {(min(r), max(r)) for r in found} == expected


# ---- quality ------------------------------------------------------------------------------

def kneser_ney(texts):
    """ln p of each symbol of a text, by plain loops over dictionaries."""
    size = quality.ORDER
    counts = [Counter(g for t in texts for g in zip(*(t[k:] for k in range(size))))]
    for _ in range(size - 1):
        counts.append(Counter(g[1:] for g in counts[-1]))

    def level(counts):
        of = Counter(counts.values())
        n = [of[k] for k in (1, 2, 3, 4)]
        d = [0.5, 0.75, 0.9]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01) for k in (1, 2, 3)]
        total, off = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        return lambda g, low: (
            low if not total[g[:-1]]
            else ((counts[g] - d[min(counts[g], 3) - 1] if counts[g] else 0) + off[g[:-1]] * low) / total[g[:-1]]
        )

    levels = [level(c) for c in counts]

    def p(g, order=0):
        return 1 / quality.SYMBOLS if order == size else levels[order](g, p(g[1:], order + 1))

    return lambda t: [math.log(p(g)) for g in zip(*(t[k:] for k in range(size)))]


@pytest.mark.parametrize("hot", [quality.HOT, 2000, 0])
def test_perplexity_equals_a_plain_loop(spark, hot):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").where("lang = 'de' and length(text) < 900 and text <> ''").limit(150)
    docs = materialise(docs, "some")
    ids = table(spark, sf, "labels").where("quality = 1 and doc_id % 2 = 0").select("doc_id")
    rows = quality.scored(docs, ids, hot=hot).collect()
    trusted = {r.doc_id for r in rows if r.trusted}
    half = {r.doc_id: (r.half, r.text) for r in docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()}

    def symbols(text):
        end = quality.LINE_END
        return [end] * (quality.ORDER - 1) + [*quality._SYMBOL[np.frombuffer(text.encode(), np.uint8)].tolist(), end]

    known = {h: [symbols(t) for i, (x, t) in half.items() if i in trusted and x == h] for h in (0, 1)}
    assert known[0] and known[1]
    models = {0: kneser_ney(known[1]), 1: kneser_ney(known[0]), None: kneser_ney(known[0] + known[1])}
    for r in rows:
        logs = models[half[r.doc_id][0] if r.trusted else None](symbols(half[r.doc_id][1]))
        assert r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)


def test_quantiles_are_exact_and_ties_stay(spark):
    draw = random.Random(1)
    rows = [(lang, round(math.exp(draw.gauss(2, 1)) + 1, 3 if lang == "a" else 1)) for lang in "aab" for _ in range(700)] + [("c", 5.0)] * 9 + [("d", 1.0)]
    scores = spark.createDataFrame(rows, "lang string, perplexity double")
    found = {r.lang: r.threshold for r in quality.exact_quantiles(scores, 0.95).collect()}
    for lang in "abcd":
        values = sorted(v for x, v in rows if x == lang)
        assert found[lang] == values[math.ceil(0.95 * len(values)) - 1]
    scores = scores.withColumns({"trusted": F.lit(True), "model": F.col("lang"), "doc_id": F.lit(1)})
    kept = quality.judged(scores, 0.95).where("perplexity = threshold")
    assert kept.where("not kept").isEmpty() and kept.where("lang = 'c'").count() == 9


# ---- URLs ---------------------------------------------------------------------------------

@pytest.mark.parametrize("pattern, needs", [
    (r"(?:^|[./-])casino[./-]", (("casino",),)), (r"/(?:cheap|dear)-pills/", (("cheap", "dear"), ("pills",))),
    (r"casino", ()), (r"/a1?/b2/", (("b2",),)), (r"/x(?:1|2)y\.", (("x1y", "x2y"),)), (r"(?i)/ads/", ()),
    (r"/ads+/[0-9]+/end$", (("end",),)), (r"/(ads|ban.er)/", ()), (r"/-+top\b", (("top",),)), (r"[^/]ads/", ()), ("", ()),
])
def test_tokens_that_a_pattern_needs(pattern, needs):
    assert url_filter.needed(pattern) == needs


def test_index_equals_all_rules_on_all_urls(spark):
    draw = random.Random(9)
    words = [f"{a}{b}" for a in ("ad", "shop", "news", "x") for b in ("", "1", "s", "-go", "_q", ".b")]
    word = lambda: draw.choice(words)
    urls = [f"http://{word()}.{word()}.{draw.choice(['com', 'org', 'net'])}/{'/'.join(word() for _ in range(draw.randrange(4)))}" for _ in range(700)]
    urls += [None, "", "no scheme", "http://", "http://ad.com", urls[0], urls[0], "http://ad.com/" + "shop1/" * 20_000]
    rules = [(draw.choice(["allow", "block"]), f"{word()}.com" if i % 3 else "org", "/" + word()[:draw.randrange(4)]) for i in range(300)]
    shapes = [r"/{}[./]", r"(?:^|[./-]){}(?:-go|s)?/", r"{}", r"/(?:{}|{})/", r"[./]{}.*{}$", r"\b{}\b", r"/{}{{1,2}}/"]
    patterns = [("block", draw.choice(shapes).format(*(re.escape(word()) for _ in range(2)))) for _ in range(40)]
    known = url_filter.all_rules({r[1:]: r for r in rules}.values(), patterns)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judge(rows, known).collect()
    assert len(found) == len(urls)
    for r in found:
        fits = [k for k in known if r.host and re.match(k.pattern, r.host + r.path)]
        named = max((k for k in fits if k.name), key=lambda k: (len(k.name), k.name), default=None)
        expected = (named.name, named.verdict) if named else (None, "block" if any(k.verdict == "block" for k in fits) else "allow")
        assert (r.rule, r.verdict) == expected


# ---- fingerprints and sequences -----------------------------------------------------------

def test_fingerprints_are_bounded_and_see_order_and_repeats(spark):
    one, two, three = "First sentence. ", "Second one. ", "And a third. "
    texts = [(one + two + three, three + two + one), (one + two, one + two + two), (one, one)]
    prints = [fingerprint.fingerprint(F.col(c)).alias(c) for c in "ab"]
    rows = spark.createDataFrame(texts, "a string, b string").select(*prints).select(fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [3 / 4, 2 / 3, 1.0]
    long = " ".join(f"Sentence {i} ends here." for i in range(20_000))
    other = long.replace("Sentence 7", "Phrase 7")
    row = spark.createDataFrame([(long, other)], "a string, b string").select(*prints).select("a", fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).first()
    assert len(row.a) < 1300
    exact = (20_000 - 1111) / (20_000 + 1111)
    assert abs(row.x - exact) < 0.1


def test_ranks_are_dense_in_any_number_of_shards(spark):
    pieces = spark.range(500).select(
        F.col("id").alias("row"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 5).otherwise(0).alias("cls"))
    counts = {5: 167, 0: 333}
    for most in (20, 10_000):
        ranks = defaultdict(list)
        for r in packing.ranked(pieces, counts, most).collect():
            ranks[r.cls].append(r["rank"])
        assert {c: sorted(x) for c, x in ranks.items()} == {c: list(range(n)) for c, n in counts.items()}
