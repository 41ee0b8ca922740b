"""Every operator on rows with nulls, blanks, ties, repeats, long texts and clashing names, and
against SQL, brute force, an exact round trip or held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystride.llm import (
    components, exact_dedup, fingerprint, line_dedup, mixing, near_dedup, packing, quality, rans, surrogates, url_filter,
)
from keystride.llm.common import UPPER, LOWER, row_key, stored, table
from keystride.llm.queries import ORACLES, QUERIES
from keystride.llm.tokens import PieceEncoder

BYTE_BPE, WORD_BPE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, row long, sha string, size long, id long, node long, n int"
CLASH = (7, "x", 7, 7, 7, 7)
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, "The cat sat on the mat.\nThe end.", "en", "b"), (2, "the CAT sat on the mat.\nThe end.", "en", "a"),
    (3, None, "en", None), (4, "", None, "a"), (5, " \n\t ", "de", "b"), (6, "one", "en", None), (7, LONG, "en", "c"),
    (7, "a tie of ids", "en", "b"), (8, "repeated row", "en", "a"), (8, "repeated row", "en", "a"),
    (None, "no id at all", None, None), (9, "É  two\n\nblank  spaces   here ", "fr", "c"), (10, "a b c d e f g h i j k l", "en", "b"),
    (11, "x\x00y \U0001f600 'll don't 123", "en", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([r + CLASH for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_row_keys_do_not_depend_on_how_files_are_cut(spark, sf, edge):
    whole, number = table(spark, sf, "documents"), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(number)
    scans = []
    try:
        for size in ("64m", "64k"):
            spark.conf.set(number, size)
            docs = table(spark, sf, "documents")
            scans.append({(r[0], tuple(r[1])) for r in docs.select("doc_id", row_key(docs)).collect()})
    finally:
        spark.conf.set(number, before)
    assert scans[0] == scans[1] and len({key for _, key in scans[0]}) == whole.count()
    assert stored(whole) is whole
    clash = stored(edge.withColumn("_metadata", F.lit(7)).withColumn("row_index", F.lit(7)))
    assert clash.select(row_key(clash)).distinct().count() == len(ROWS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) > 0


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    for found in (
        fingerprint.fingerprints(empty), packing.pack(empty, BYTE_BPE), surrogates.replaced(empty), mixing.mix(empty),
        mixing.mixed_documents(empty), exact_dedup.exact_dedup(empty), exact_dedup.drop_duplicates(empty), url_filter.judge(pages),
        rans.round_trip(empty, WORD_BPE), line_dedup.without_boilerplate(empty), near_dedup.near_dedup(empty),
        near_dedup.drop_near_duplicates(empty), quality.classify(empty, labels), quality.drop_rejected(empty, labels),
    ):
        assert found.collect() == []


# ---- fingerprints -------------------------------------------------------------------------

def test_fingerprints_of_odd_rows(edge):
    rows = fingerprint.fingerprints(edge).collect()
    assert len(rows) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {r.doc_id: r for r in rows}
    first, second = order[0][1], order[1][1]
    n = len(first)
    edited = first[:n - n // 4] + second[:n // 4]
    import hashlib
    assert by_id[None].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert by_id[3].n_chars == 0 and by_id[3].fingerprint == by_id[4].fingerprint and by_id[3].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert by_id[7].fingerprint != by_id[8].fingerprint


def test_one_row_follows_itself(spark):
    row = fingerprint.fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert row.near_next == 1.0 and row.near_edited < 1


def test_changed_sections_name_the_edit(spark):
    lines = [f"line {i} of a text that is long enough\n" for i in range(60)]
    other = lines[:40] + ["another line\n"] + lines[41:]
    a, b = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string").select(
        *[fingerprint.fingerprint(F.col(c)).alias(c) for c in "ab"]
    ).select(fingerprint.changed_sections(F.col("a"), F.col("b")), fingerprint.likeness(F.col("a"), F.col("b"))).first()
    assert 1 <= len(a) <= 2 and 0.9 < b < 1


# ---- exact and near duplicates ------------------------------------------------------------

def test_exact_dedup_of_odd_rows(edge):
    rows = exact_dedup.exact_dedup(edge).collect()
    up = str.maketrans(UPPER, LOWER)
    groups = defaultdict(list)
    for r in ROWS:
        groups[(r[1] or "").translate(up)].append(r[0])
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == Counter(
        (i, max(ids, key=lambda x: (x is not None, x or 0)), len(ids)) for ids in groups.values() for i in ids)
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.drop_duplicates(edge).count() == len(groups) and exact_dedup.drop_duplicates(edge).columns == edge.columns


def test_frequent_digests_are_found_and_verified(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.digests(docs)
    found = exact_dedup.frequent_digests(rows, 1 / 64).collect()
    assert [(r.group_size, r.top.doc_id) for r in found] == [(1000, 2997)]
    assert exact_dedup.exact_dedup(docs, support=1 / 64).where("kept").count() == 2001


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    if len(words) < 2:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:]))


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (name, _) in enumerate(docs):
        if name is not None:
            least[find(i)].append(name)
    return Counter((name, len(sets[i]), min(least[find(i)], default=None)) for i, (name, _) in enumerate(docs))


def found_components(docs):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect())


def test_near_dedup_against_brute_force(spark, sf, documents, edge):
    assert found_components(table(spark, sf, "documents")) == brute_components(documents)
    assert found_components(edge) == brute_components([r[:2] for r in ROWS])


def test_near_dedup_of_a_large_family(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(160)]
    docs = []
    for i in range(260):  # long lists, blocks, and similarities on both sides of the limit
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        docs.append((i, " ".join(words[rng.randrange(0, 20):])))
    docs += [(1000 + i, "the same three " + f"tail{i % 3}") for i in range(30)]
    monkeypatch.setattr(near_dedup, "FAMILY_ROWS", 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    path = near_dedup.materialise(frame, "test")
    assert found_components(path) == brute_components(docs)
    kept = near_dedup.drop_near_duplicates(path)
    assert kept.count() == len({c for _, _, c in brute_components(docs)})


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 202), (202, 201)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200, 202: 200}


# ---- mixing -------------------------------------------------------------------------------

def test_mixing_of_odd_rows(edge):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    sizes = Counter(len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in ROWS)
    assert Counter(r.size for r in rows) == sizes
    assert Counter(rows) == Counter(mixing.mix(edge).collect())
    words = sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in mixing.mixed_documents(edge).collect())
    assert words == sum(r.taken for r in rows)


def test_mix_meets_its_targets(spark, sf):
    docs = table(spark, sf, "documents")
    rows = mixing.mix(docs).toPandas()
    sources = rows.groupby(["target", "source_size"], as_index=False)["taken"].sum()
    assert (abs(sources["taken"] - sources["target"]) <= 2).all()
    assert abs(sources["target"].sum() - 1.5 * rows["size"].sum()) < 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.words())).first()[0] == rows["taken"].sum()


# ---- tokens -------------------------------------------------------------------------------

def reference_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = [r[1] for r in ROWS] + ["  ", " ", "a  b   c", "\n b", "y ", "Σ Σας\t x", "İI É  x", "a\x00 b c", "e\u0301 E\u0301", "<|endoftext|> x", "\u00a0 b", "a\x1cb \x85c"]


@pytest.mark.parametrize("path, opens", [(BYTE_BPE, True), (WORD_BPE, False)])
def test_pieces_have_the_ids_of_the_text(documents, path, opens):
    texts = [t or "" for t in ODD] + [t for _, t in documents]
    encoder = PieceEncoder(path, opens, not opens, kept=5000)
    ids, ends = encoder.encode(texts)
    starts = [0, *ends.tolist()]
    for want, a, b in zip(reference_ids(path, texts), starts, starts[1:]):
        assert ids[a:b].tolist() == want[:-1]


def check_packing(rows, docs, window):
    wanted = Counter()
    for (name, _), ids in zip(docs, reference_ids(BYTE_BPE, [t for _, t in docs])):
        for at in range(0, len(ids), window):
            part = ids[at:at + window]
            wanted[name, at, len(part), crc(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(r.length for r in rows), len(sequences) * window


def test_packing(spark, sf, edge, documents):
    check_packing(packing.pack(edge, BYTE_BPE).collect(), [r[:2] for r in ROWS], 2048)
    check_packing(packing.pack(edge, BYTE_BPE, window=64, step=4).collect(), [r[:2] for r in ROWS], 64)
    used, room = check_packing(packing.pack(table(spark, sf, "documents"), BYTE_BPE).collect(), documents, 2048)
    assert used / room > 0.97


def test_plans_use_every_piece_once():
    rng = random.Random(1)
    for units in (4, 16, 64):
        for _ in range(5):
            histogram = {k: rng.randrange(200) for k in range(1, units + 1) if rng.random() < 0.7}
            used = Counter()
            for classes, n in packing.plan(histogram, units):
                assert sum(classes) <= units and n > 0
                for c in classes:
                    used[c] += n
            assert used == Counter({k: n for k, n in histogram.items() if n})


def test_nnls_finds_the_constrained_minimum():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 6)), rng.random(12) - 0.3
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_rans_files(spark, sf, edge, documents):
    for docs, rows in ((edge, [r[:2] for r in ROWS]), (table(spark, sf, "documents"), documents)):
        found = rans.round_trip(docs, WORD_BPE).collect()
        ids = reference_ids(WORD_BPE, [t for _, t in rows])
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((n, len(x), crc(x)) for (n, _), x in zip(rows, ids))
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        names = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
        assert names == sorted(names, key=lambda x: (x is not None, x or 0))


def test_rans_segments(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(rans, "BLOCK_IDS", 3000)
    for ids in (np.zeros(1, np.uint32), np.full(5000, 9, np.uint32), rng.zipf(1.3, 20_000).clip(0, 49_000).astype(np.uint32)):
        cuts = sorted({0, len(ids), *rng.integers(0, len(ids) + 1, 5).tolist()})
        lengths = np.diff(cuts).tolist()
        data = rans.encode_segment(list(range(len(lengths))), lengths, ids)
        segment = rans.Segment(data)
        assert (segment.ids() == ids).all()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert (segment.document(i) == ids[a:b]).all()
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.Segment(bytes(bad))


# ---- URLs ---------------------------------------------------------------------------------

def test_url_rules(spark):
    urls = [
        "http://Example.org/es/1", "https://a.example.org/en/12?x", "http://example.org/en/2", "http://example.org", "http://notexample.org/es/",
        "ftp://x.com/fr/1#t", "http://x.com/de/", "http://x.net/a", None, "no scheme", "http://www.cheap-pills.net/x", "://", "http://x.com/\n/de/", "a://b://org/",
    ]
    rows = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert found[0] == ("example.org", "/es/1", "example.org/es/", "block")
    assert found[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert found[2] == ("example.org", "/en/2", "org/", "allow")
    assert found[3] == ("example.org", "", None, "allow")
    assert found[4][2:] == ("org/", "allow")
    assert found[5][2:] == ("com/fr/", "allow") and found[6][2:] == ("com/de/", "block")
    assert found[7][2:] == (None, "allow") and found[8] == found[9] == ("", "", None, "allow") and found[11] == ("", "", None, "allow")
    assert found[10][2:] == (None, "block") and found[12][2:] == (None, "allow") and found[13][:2] == ("b:", "//org/")


# ---- lines, personal data, quality --------------------------------------------------------

def test_lines(spark, edge):
    rows = line_dedup.without_boilerplate(edge, least=2).collect()
    assert Counter((r.doc_id, r.n_removed) for r in rows)[1, 1] == 1
    assert {r.doc_id: r.text for r in rows}[1] == "The cat sat on the mat."
    many = spark.createDataFrame(
        [(i, f"line on {n} sites\n\nown {i}", f"s{k}") for i, (n, k) in enumerate((n, k) for n in range(1, 13) for k in range(n))],
        "doc_id long, text string, source string")
    for r in line_dedup.without_boilerplate(many, least=7).collect():
        n = int(re.search(r"\d+", many.where(F.col("doc_id") == r.doc_id).first().text)[0])
        assert r.n_removed == (n >= 7) and r.n_lines == 3


def test_surrogates(spark, edge):
    text = ('Ask Mrs. Maria Stone or MARIA@HOST.COM, maria@host.com at 10.1.2.3, +1 (017) 555-7713, 4734663219866878; '
            'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Herr Anton is not Frau Anton. г-жа Иванова. Version 2.0, 4.0. End')
    docs = spark.createDataFrame([(1, text), (2, text.replace("10.1.2.3", "10.1.2.4")), (3, None)], "doc_id long, text string")
    one, two, three = (r for r in sorted(surrogates.replaced(docs).collect()))
    assert three.text == "" and three.n_entities == 0 and one.n_entities == 10
    for private in ("Stone", "MARIA", "maria@", "10.1.2.3", "555-7713", "4734663219866878", "04dbebab", "Anton", "Иванова"):
        assert private not in one.text
    assert "Version 2.0, 4.0. End" in one.text and one.text != two.text
    assert re.search(r"Mrs\. (Alba|Berit|Carla|Dora|Elin|Flora|Greta|Hanna) [A-Z][a-z]+ or [A-Z.0-9]+@MAIL\.EXAMPLE\.INVALID, [a-z.0-9]+@mail", one.text)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, \d{16};", one.text) and re.search(r'"[0-9a-f]{40}"', one.text)
    loud, quiet = re.findall(r"[A-Z.0-9a-z]+@[A-Za-z.]+", one.text)
    assert loud.lower() == quiet
    assert re.search(r"г-жа [А-Я][а-я]+", one.text)
    assert surrogates.replaced(edge).count() == len(ROWS)


def test_near_duplicates_without_ids_leave_one(spark):
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(words[:-1] + ["end"])
    rows = [(None, near), (None, other), (None, near), (None, "alone it is"), (None, ""), (None, None), (4, "x y z"), (None, "x y z"), (3, "x y z")]
    left = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.text in (near, other) for r in left) == 1 and [r.doc_id for r in left if r.text == "x y z"] == [3]
    assert len(left) == 5


def test_surrogates_of_an_entity_agree(spark):
    texts = [
        "call +1 (017) 555-7713 or +1 017 555 7713 or +10175557713", "pay 4734 6632 1986 6878 or 4734663219866878",
        "Mr Stone and Mr. Stone and Stone, and Dr. Stone, Prof. Dr. Stone", "Mrs. Maria Stone, Mrs. Stone, Maria Stone; Maria and Dr. Maria Stone",
        "г-жа Анна Иванова, Иванова", "Stone without a title. Paris stays", "Mrs. Anna Stone",
    ]
    rows = {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [rows[i].text for i in range(len(texts))]
    phones, cards = re.findall(r"\+[\d ()-]+\d", found[0]), re.findall(r"\d[\d ]+\d", found[1])
    assert [re.sub(r"\d", "0", p) for p in phones] == ["+0 (000) 000-0000", "+0 000 000 0000", "+00000000000"]
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and phones[0].startswith("+1 (") and phones[1] != "+1 017 555 7713"
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] != "4734663219866878" and cards[0].count(" ") == 3
    stone = re.fullmatch(r"Mr ([A-Z][a-z]+) and Mr\. \1 and \1, and Dr\. \1, Prof\. Dr\. \1", found[2])[1]
    maria, other = re.fullmatch(r"Mrs\. ([A-Z][a-z]+) ([A-Z][a-z]+), Mrs\. \2, \1 \2; \1 and Dr\. \1 \2", found[3]).groups()
    assert stone == other != "Stone" and maria in surrogates.GIVEN["latin", "f"]
    assert re.fullmatch(r"г-жа [А-Я][а-я]+ ([А-Я][а-я]+), \1", found[4]) and "Иванова" not in found[4]
    assert found[5] == texts[5] and rows[5].n_entities == 0 and rows[2].n_entities == 5 and rows[3].n_entities == 6
    assert found[6].endswith(stone) and found[6].split()[1] != maria


def test_surrogates_that_collide_are_drawn_again(spark, monkeypatch):
    draw = lambda kind, form, attempt: F.when(attempt < 2, F.lit("c")).otherwise(F.concat(F.lit("s"), form))
    monkeypatch.setattr(surrogates, "surrogate", draw)
    forms = spark.createDataFrame([("ip", x) for x in "abcde"], "type string, form string")
    found = {r.form: r.surrogate for r in surrogates.dictionary(forms).collect()}
    assert len(set(found.values())) == 5 and not set(found.values()) & set(found)


def test_a_full_format_grows(spark):
    # Of 100 numbers behind the code, 60 are real: 40 are left for 60 surrogates.
    forms = spark.createDataFrame([("phone", f"+250 {i:02d}") for i in range(60)], "type string, form string")
    found = {r.form: r.surrogate for r in surrogates.dictionary(forms).collect()}
    assert len(found) == len(set(found.values())) == 60 and not set(found.values()) & set(found)
    assert all(re.fullmatch(r"\+250 \d{2,4}", x) for x in found.values()) and any(len(x) == 7 for x in found.values())
    text = "+2500 points, +5 100 more, +1-800; +1 800 555 0100"
    row = surrogates.replaced(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_entities == 1 and row.text.startswith("+2500 points, +5 100 more, +1-800; +1 ") and not row.text.endswith("800 555 0100")


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    shown = labels.where("doc_id % 4 <> 0")
    held = quality.classify(docs, shown).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    good, bad = held[held["quality"] == 1], held[held["quality"] == 0]
    assert good["kept"].mean() > 0.93 and bad["kept"].mean() < 0.4


def test_a_language_without_trusted_text_stays(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    for withheld in ("es", "de"):
        shown = labels.join(docs.where(F.col("lang") == withheld).select("doc_id"), "doc_id", "left_anti")
        found = quality.classify(docs, shown).toPandas()
        foreign = found[found["lang"] == withheld]
        assert len(foreign) and foreign["kept"].all() and foreign["threshold"].isna().all()
        assert foreign["perplexity"].notna().any() and not found[found["lang"] == "en"]["kept"].all()


def test_a_language_with_few_trusted_texts_keeps_its_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").where("lang = 'de'")
    labels = table(spark, sf, "labels").join(docs.select("doc_id"), "doc_id")
    good = sorted(r.doc_id for r in labels.where("quality = 1").select("doc_id").collect())
    for n in (3, 16):
        found = quality.classify(docs, labels.where(F.col("doc_id").isin(good[:n]))).toPandas().set_index("doc_id")
        assert found.loc[good[n:]]["kept"].mean() > 0.85, n


def test_model_is_a_distribution(spark):
    texts = spark.createDataFrame([("x", t) for t in ("aba abc abcab", "bca cab ab", "hello there")], "lang string, text string")
    value = {r.key: r.value / quality.UNIT for r in quality.model(quality.counted(texts)).collect()}
    symbols = np.arange(quality.SYMBOLS, dtype=np.int64)
    for ctx in (b"\n\n\n", b"aba", b"cab", b"zzz", b"zab", b"zza", b" he"):
        grams = int.from_bytes(ctx, "big") << 8 | symbols
        logs = sum(np.array([value.get(k, 0.0) for k in keys.tolist()]) for keys in quality.keys_of(grams))
        assert abs(np.exp(logs).sum() / quality.SYMBOLS - 1) < 1e-4


def test_where_the_cut_falls_changes_no_perplexity(spark):
    sf = "/root/testdata/sf0.001"
    docs, ids = table(spark, sf, "documents"), quality.trusted_ids(table(spark, sf, "labels"))
    found = [sorted(map(tuple, quality.scored(docs, ids, hot=hot).select("doc_id", "model", "perplexity").collect())) for hot in (quality.HOT, 500, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()


def test_quality_of_odd_rows(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(edge, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(r.kept and r.perplexity is None for r in rows if r.doc_id in (3, 4))
    untrained = quality.classify(edge, labels.limit(0)).collect()
    assert len(untrained) == len(ROWS) and all(r.kept for r in untrained)


# ---- the pipeline -------------------------------------------------------------------------

def test_pipeline_against_its_operators_one_by_one(spark, sf, documents):
    docs, text = table(spark, sf, "documents"), dict(documents)
    good = {r.doc_id for r in quality.classify(docs, table(spark, sf, "labels")).where("kept").collect()}
    latest = {}
    for name in sorted(good):
        latest[text[name].translate(str.maketrans(UPPER, LOWER))] = name
    single = sorted(latest.values())
    stay = {c for _, _, c in brute_components([(n, text[n]) for n in single])}
    kept = mixing.materialise(docs.where(F.col("doc_id").isin(list(stay))), "kept")
    words = {r.doc_id: r.taken for r in mixing.mix(kept).collect()}
    found = corpus_pipeline.run(spark, sf).collect()
    copies = Counter(r.doc_id for r in found if r.start == 0)
    assert set(copies) <= stay and 0.8 * len(documents) > len(stay) > 0.5 * len(documents)
    sizes = {n: len(re.findall(r"[^\x20\x09-\x0d]+", text[n])) for n in stay}
    assert copies == Counter({n: -(-words[n] // max(1, sizes[n])) for n in stay if words[n]})
    lengths = Counter()
    for r in found:
        lengths[r.doc_id] += r.length
    whole = dict(zip(stay, map(len, reference_ids(BYTE_BPE, [text[n] for n in stay]))))
    assert all(lengths[n] == copies[n] * whole[n] for n in copies if words[n] % max(1, sizes[n]) == 0)
