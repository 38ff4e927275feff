"""Periodic runs against a search by definition, with forced hash collisions and odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pvlens.llm import periodic_runs as R
from pvlens.llm.queries import planted, queries


def by_definition(words, exponent=4, least=6):
    """Every maximal stretch of words p apart alike, with the smallest p that fits it."""
    n, found = len(words), set()
    for p in range(1, n // exponent + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            length = e - s + p
            if e > s and length >= max(least, exponent * p):
                stretch = words[s : s + length]
                q = next(q for q in range(1, p + 1) if all(stretch[i] == stretch[i + q] for i in range(length - q)))
                found.add((s, length, q))
            s = max(e, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng):
    out = []
    for _ in range(rng.randrange(6)):
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        out += block * rng.randrange(1, 9) + [rng.choice("abcxyz") for _ in range(rng.randrange(4))]
    return out


def searched(texts, exponent=4, least=6, seed=0):
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = [[] for _ in texts]
    for t, s, n, q in R.find_runs(ids, bounds, exponent, least, seed).tolist():
        got[t].append((s, n, q))
    return got


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 5)])
def test_equal_to_the_definition(exponent, least, monkeypatch):
    rng = random.Random(exponent)
    texts = [random_words(rng) for _ in range(400)] + [list("ab" * 60), list("a" * 200), list("aab" * 30 + "aab"[:2]), list("abaababaabaab" * 12), [], ["a"]]
    want = [by_definition(t, exponent, least) for t in texts]
    assert searched(texts, exponent, least) == want
    monkeypatch.setattr(R, "PAIRS", 50)  # many blocks
    assert searched(texts, exponent, least) == want
    assert any(len(w) > 3 for w in want)


def test_false_hashes_are_found_out(monkeypatch):
    rng = random.Random(8)
    texts = [random_words(rng) for _ in range(200)]
    want = [by_definition(t) for t in texts]
    real, tried = R.Prefixes.same, []

    def same(self, i, length, step):
        tried.append(self.seed)
        return real(self, i, length, step) | (self.seed == 0) & (length % 7 == 3)

    init = R.Prefixes.__init__
    monkeypatch.setattr(R.Prefixes, "__init__", lambda self, ids, seed: (init(self, ids, seed), setattr(self, "seed", seed))[0])
    monkeypatch.setattr(R.Prefixes, "same", same)
    assert searched(texts) == want
    assert set(tried) == {0, 1}


def test_arithmetic():
    rng = random.Random(1)
    m = (1 << 61) - 1
    a, b = ([rng.randrange(m) for _ in range(1000)] + [m - 1, 0] for _ in range(2))
    assert R.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % m for x, y in zip(a, b)]
    ids = np.array([rng.randrange(3) for _ in range(500)])
    h = R.Prefixes(ids, 4)
    for _ in range(500):
        i, p = rng.randrange(250), rng.randrange(1, 100)
        n = rng.randrange(0, 6)
        assert bool(h.same(np.array([i]), np.array([n]), np.array([p]))[0]) == (ids[i : i + n].tolist() == ids[i + p : i + p + n].tolist())


def test_long_runs_are_searched_once():
    big = np.concatenate([np.zeros(300_000, np.int64), np.arange(1, 1000), np.tile(np.arange(7), 5000)])
    assert R.find_runs(big, np.array([0, len(big)])).tolist() == [[0, 0, 300_000, 1], [0, 300_999, 35_000, 7]]


def digest(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = by_definition(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *facts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op12_periodic_runs"](spark, d).collect()}
    assert got == {i: digest(i, t) for i, t in texts.items()}
    assert sum(x[0] > 0 for x in got.values()) > 5


def test_planting():
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    for i in ids:
        words = [str(k).encode() for k in range(50)]
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert planted(i, words) == [words[k] if k < a else words[a + (k - a) % p] for k in range(50)]
        assert planted(i, []) == [] and planted(i, [b"x"]) == [b"x"]
    assert planted(None, [b"x", b"y"]) == [b"x", b"y"]


def test_odd_rows(spark):
    schema = "doc_id long, text string, runs string, _text int"
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, " \n\t ", "x", 3), (None, "a " * 9, "x", 4), (4, "b c " * 9, "x", 5), (4, "b c " * 9, "x", 5), (5, "x" * 100_000 + " y" * 8, "x", 6), (6, "é é é\x1cé " * 5, "x", 7)]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.start, r.length, r.period, r._text): r.collapsed_text for r in R.periodic_runs(docs, keep=("_text",)).collect()}
    assert got == {
        (1, 0, (), None, None, None, 1): "", (2, 0, (), None, None, None, 2): "", (3, 0, (), None, None, None, 3): "", (None, 9, ((0, 9, 1),), 0, 9, 1, 4): "a",
        (4, 18, ((0, 18, 2),), 0, 18, 2, 5): "b c", (5, 9, ((1, 8, 1),), 1, 8, 1, 6): "x" * 100_000 + " y", (6, 10, ((0, 10, 2),), 0, 10, 2, 7): "é é é\x1cé",
    }
    assert R.periodic_runs(docs).count() == len(rows)
    assert R.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(docs, exponent=1)
