"""Collocations against a plain loop, with colliding fingerprints, odd rows and long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from keystride.llm import phrases
from keystride.llm.common import LOWER, UPPER, table

SCHEMA = "doc_id long, text string, lang string, print long, width int, f long, phrase string, row long, doc long"
CLASH = (7, 7, 7, "x", 7, 7)


def plain(rows, least, top, covered=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    around[part] = max(around[part], a)
        rows_of = []
        for p, a in candidates.items():
            if 100 * around[p] < covered * a:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows_of.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        found += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_of)[:top], 1)]
    return sorted(found)


def random_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["The", "a", "É x", "x\x00y", "\U0001f600", "don't", "b", "c-d", "und", "of"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "! "]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("de", " \t\n.;"), ("en", "one"), *[("fr", "same text again and again")] * 12]


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, *CLASH) for i, (lang, text) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("bits, held, least, top", [(64, 1 << 21, 3, 2000), (5, 50, 3, 2000), (9, 200, 2, 7)])
def test_equals_a_plain_loop(spark, bits, held, least, top):
    rows = random_rows(bits)
    got = phrases.collocations(frame(spark, rows), least=least, top=top, bits=bits, held=held)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, top)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rng = random.Random(1)
    words = ["ab", "c", "defg", "é"]
    rows = [("en", "".join(rng.choice(words) + rng.choice([" ", " ", ". "]) for _ in range(400))) for _ in range(5)]
    rows += [("en", " ".join(rng.choice(words) for _ in range(300))), ("en", "." * 100)]
    want = Counter()
    for _, text in rows:
        want.update(piece for piece in text.split(".") if piece.strip())
    data = rows[0][1].encode()
    monkeypatch.setattr(phrases, "RUN_BYTES", 64)
    parts = list(phrases._runs(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    assert len(parts) > 5 and b"".join(p.tobytes() for p, _, _ in parts) == data
    grams = Counter()
    for part, bounds, _ in parts:
        found = phrases.Words(part, bounds, np.zeros(1, np.uint64))
        grams.update(found.phrase(int(i), 3) for i in found.grams(3)[0])
    assert grams == Counter(
        " ".join(w[i:i + 3]) for w in (p.split() for p in rows[0][1].split(".")) for i in range(len(w) - 2)
    )


def test_hashes_do_not_depend_on_the_place():
    values = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    twice = np.concatenate([values, values])
    starts = np.arange(0, 400)
    first = phrases.range_hashes(twice, starts, starts + 50, 0x9E3779B97F4A7C15)
    assert (first == phrases.range_hashes(twice, starts + 500, starts + 550, 0x9E3779B97F4A7C15)).all() and len(set(first)) == 400


def test_empty_and_large_counts(spark):
    assert phrases.collocations(frame(spark, [("en", "x")]).limit(0)).collect() == []
    big = 5_000_000_000
    rows = [("en", 1, "a", 2 * big), ("en", 1, "b", 3 * big), ("en", 2, "a b", big)]
    table_of = spark.createDataFrame(rows, "lang string, width int, phrase string, f long")
    assert [tuple(r) for r in phrases.scored(table_of).collect()] == [("en", 2, "a b", big, 2 * big, 3 * big, 1_000_000 * big * big // (6 * big * big))]


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("lang", "text").collect()]
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, sf, "documents")).collect())
    assert got == plain(rows, 10, 2000) and len(got) > 100
