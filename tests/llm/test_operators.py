"""Each operator against brute force, and on nulls, empty texts, repeats, ties and empty tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvlens.llm import exact_dedup, line_dedup, mixing, near_dedup, pieces, sharding, substring_dedup, token_files, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d int, _text string"


def words(rng, n):
    return " ".join(rng.choice(("", "ba", "ke", "lo")) + rng.choice(("mi", "nu", "po", "qua")) + rng.choice(("", "r", "st")) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.choice((3, 40, 90, 200))) for _ in range(24)]
    passage = words(rng, 60)
    texts = [*base, base[3], base[3], base[4] + " " + passage, passage + " " + base[5], base[6] + " tail", base[7].replace("po", "PO", 1), "", None, "  \n\t ", "one two", "\n".join(base[8:11]), "\n".join([base[9], "short", base[8]])]
    texts += [base[10] + "\n" + base[11], base[11] + "\n" + base[10] + "\n" + base[10], "é ü " * 30, "x" * 70_000 + " " + passage]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1, 7, "clash") for i, t in enumerate(texts)]
    out += [out[3], (None, "no id here", "en", "s1", 1, 7, "clash"), (None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(spark, docs, rows, empty):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs, huge_bytes=50_000).collect())
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    want = collections.Counter((r[0], max((i for i in by[r[1] or ""] if i is not None), default=None), len(by[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert got == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_fingerprints_combine():
    raw = np.frombuffer(bytes(range(256)) * 1000, np.uint8)
    whole = exact_dedup.fingerprints(raw, np.array([0, len(raw)]))
    cut = 70_001
    parts = [tuple(int(x[0]) for x in exact_dedup.fingerprints(raw, np.array(ab))) + (ab[1] - ab[0],) for ab in ([0, cut], [cut, len(raw)])]
    assert exact_dedup.combine(*parts)[:2] == tuple(int(x[0]) for x in whole)


def test_substring(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect())
    w, seen = 35, collections.Counter()
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for _, t in split:
        seen.update(tuple(t[k : k + w]) for k in range(len(t) - w + 1))
    want = collections.Counter()
    for i, t in split:
        gone = [any(seen[tuple(t[k : k + w])] > 1 for k in range(max(0, p - w + 1), min(p, len(t) - w) + 1)) for p in range(len(t))]
        want[(i, len(t), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(t, gone) if not g)).hexdigest())] += 1
    assert got == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def brute_roots(rows):
    sets = []
    for r in rows:
        t = (r[1] or "").encode().split()
        n = min(5, len(t))
        sets.append(collections.Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1)) if t else collections.Counter())
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] | sets[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or both and sum((sets[i] & sets[j]).values()) / both >= 0.8:
                part[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute_classes(rows):
    low, roots = {}, brute_roots(rows)
    for root, r in zip(roots, rows):
        low.setdefault(root, []).append(r[0])
    return [(r[0], min((x for x in low[root] if x is not None), default=None)) for root, r in zip(roots, rows)]


@pytest.mark.parametrize("small_bucket", [32, 2])
def test_near_classes(docs, rows, empty, small_bucket):
    got = near_dedup.near_duplicate_classes(docs, small_bucket=small_bucket, block_rows=2).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter(brute_classes(rows))
    assert near_dedup.near_duplicate_classes(empty).count() == 0


def test_signatures_follow_weighted_jaccard():
    rng = np.random.default_rng(1)
    g = rng.integers(1, 2**63, 300).astype(np.uint64)
    w = rng.choice([0.5, 1.0, 2.0, 3.25], 300)
    v = np.where(rng.random(300) < 0.3, w * 0.5, w)
    s = near_dedup.dart_signatures(np.repeat([0, 1], 300), np.tile(g, 2), np.concatenate([w, v]), 2, 2000)
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_lines(docs, empty):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect() if r.doc_id is not None}
    assert got[24].n_removed == 1 and got[24].kept_text == ""
    assert got[3].n_removed == 0
    assert (got[34].n_lines, got[34].n_removed) == (3, 3)
    assert got[35].kept_text == "short"
    assert got[37].n_removed == 2 and got[37].n_lines == 3  # the second copy inside one document stays
    assert line_dedup.dedup_lines(empty).count() == 0


def test_patience():
    assert line_dedup.patience([(0, 2, True), (1, 0, True), (2, 1, True), (3, 3, True)]) == [(1, 0), (2, 1), (3, 3)]
    assert line_dedup.patience([(0, 0, True), (1, 1, False), (2, 5, False), (3, 3, True)]) == [(0, 0), (1, 1), (3, 3)]


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, rows_per_bucket=1).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in got}
    assert all(sizes[i] == (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, *_ in rows if i is not None and t is not None)
    assert sharding.shard_documents(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.curriculum(docs, rows_per_bucket=2).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").encode().split())
    by = collections.defaultdict(list)
    for r in got:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        assert all(0 <= x.position <= 1 for x in r.takes)
        by[r.source].append(r)
    total = sum(size.values())
    weight = dict(zip(sorted((s for s in size if s is not None)) + [None], (5, 2, 1, 5)))
    free, target, left = set(size), {}, 1.5 * total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    for s, own in by.items():
        assert abs(own[0].target - target[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - target[s]) <= 1
    assert mixing.curriculum(empty).count() == 0
    assert mixing.schedule(mixing.curriculum(docs)).count() > 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) / 4
    x[10] = x[20]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (40, [float(v) for v in x[41]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(df, block_rows=16).collect())
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i < 300]
    want = []
    queries = [(i, a) for i, a in good if i % 20 == 0]
    by = collections.defaultdict(list)
    for q, a in queries:
        by[q] += [(-int(a @ b), i) for i, b in good if i != q]
    for q, found in by.items():
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:20])]
    assert got == sorted(want)
    assert topk.exact_topk(df.where("vec_id < 0")).count() == 0


def test_token_files(spark, docs, rows, tmp_path, empty):
    from tokenizers import Tokenizer

    folder = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, folder, segment_bytes=2000, file_segments=2)
    got = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    own = Tokenizer.from_file(token_files.vocabulary(None))
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    at = 0
    for r, (i, t, *_) in zip(got, order, strict=True):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_files.write_token_files(empty, folder + "0")
    assert token_files.read_token_files(spark, folder + "0").count() == 0


def test_pieces(docs, rows, empty):
    got = pieces.encode_documents(docs).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    own = pieces.model(None)
    scores = dict(zip((p.decode(errors="replace") for p in own.pieces), own.scores))
    for word in ("▁the", "▁quanternion", "▁überéß", "▁日本語", "abab"):
        ids = own.viterbi(word)
        assert own.decode(ids).strip() == word.replace("▁", " ").strip()
        spoken = word.replace("▁", " ")
        best = {0: 0.0}  # plain dynamic programme over characters
        for j in range(1, len(spoken) + 1):
            best[j] = max([best[i] + scores[spoken[i:j]] for i in range(j) if spoken[i:j] in scores and i in best] + [best[j - 1] + own.lowest])
        found = sum(own.scores[i] for i in ids if own.types[i] != pieces.BYTE)
        if all(own.types[i] != pieces.BYTE for i in ids):
            assert abs(found - best[len(spoken)]) < 1e-9
    assert pieces.encode_documents(empty).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(2)
    clean = [words(rng, 50) for _ in range(120)]
    bad = [words(rng, 20) + " you idiot " + words(rng, 20) + " zorgul " + words(rng, 5) for _ in range(60)]
    rows = [(i, t, "en", "s", 1, 1, "") for i, t in enumerate(clean + bad)] + [(999, None, "en", "s", 1, 1, ""), (998, "", "en", "s", 1, 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= 120) if i % 25 else 1) for i in range(180)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 182
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].predicted == 0 for i in range(120)) and all(got[i].predicted == 1 for i in range(120, 180))
    assert got[999].predicted == got[998].predicted == 0
    assert toxicity.score_documents(empty, labels).count() == 0
    alone = toxicity.score_documents(docs, labels.where("doc_id < 0")).collect()
    assert len(alone) == 182 and all(r.predicted == 0 for r in alone)


def test_label_model_counts_voters_that_repeat_each_other_once():
    rng = np.random.default_rng(5)
    n = 6000
    truth = rng.random(n) < 0.3
    hears = lambda hit, false: (np.where(truth, rng.random(n) < hit, rng.random(n) < false)).astype(int)
    first = hears(0.7, 0.2)
    votes = np.column_stack([first, first, first, hears(0.8, 0.1), hears(0.6, 0.05)])
    gold = np.where(rng.random(n) < 0.05, ~truth, truth).astype(int)
    model = toxicity.fit_label_model(votes, gold)
    linked = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert len(linked & {frozenset(x) for x in ((0, 1), (0, 2), (1, 2))}) == 2
    soft = model.posterior(np.column_stack([votes, gold]))
    only = (first == 1) & (votes[:, 3] == 0) & (votes[:, 4] == 0) & (gold == 0)
    assert abs(soft[only].mean() - truth[only].mean()) < 0.05  # three echoes of one voter are one voter


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((0, 1), 0) == 0  # clean documents are left alone
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.6


def test_topk_shared_vectors_and_repeated_ids(spark):
    """A vector of a third of all rows, ids with several vectors, rows that repeat."""
    rng = np.random.default_rng(12)
    x = [[float(v) for v in r] for r in rng.normal(size=(200, 4)).round(1)]
    rows = [(i, x[0] if i % 3 == 0 else x[i]) for i in range(200)] + [(20, x[5]), (20, x[0]), (40, x[1]), (40, x[1]), (7, x[1]), (7, x[1])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, block_rows=8, q_blocks=2, x_blocks=2).collect())
    whole = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows]
    want = []
    for q in {i for i, _ in whole if i % 20 == 0}:
        own = {tuple(v) for i, v in whole if i == q}
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for v in own for i, w in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:5])]
    assert got == sorted(want)


def test_topk_ties_and_large_values(spark):
    rng = np.random.default_rng(8)
    x = [[0.5, 0.25, 0.0]] * 90 + [[float(v) for v in r] for r in rng.normal(size=(60, 3))] + [[3e7, -2e7, 1e6], [2e7, 1e7, -5e6]]
    rows = [(i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(df, k=7, block_rows=16, q_blocks=2, x_blocks=2).collect())
    whole = [[int(np.floor(64 * c)) for c in v] for v in x]
    want = []
    for q in range(0, len(x), 20):
        found = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(len(x)) if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:7])]
    assert got == sorted(want)


def test_lexicon_comes_from_training_labels_alone(spark):
    """A word that only held-out rows mark as toxic never becomes a voter."""
    rng = random.Random(11)
    ids = list(range(400))
    away = [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [(i, f"{words(rng, 30)} {name()}" + (" stupid " if i in away[::2] else " blorf " if i not in away and i % 3 == 0 else " ") + words(rng, 30)) for i in ids]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("stupid" in t or "blorf" in t)) for i, t in texts], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).lexicon == ["blorf"]


def _library_twin(path):
    """The model file as a unigram model with the log scores used here, for the sentencepiece library."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def coded(field, x):
        if isinstance(x, float):
            return varint(field << 3 | 5) + struct.pack("<f", x)
        return varint(field << 3) + varint(x) if isinstance(x, int) else varint(field << 3 | 2) + varint(len(x)) + bytes(x)

    rows, i = pieces.read_model(path)[0], 0
    with open(path, "rb") as f:
        data = memoryview(f.read())
    parts = []
    for field, x in pieces._fields(data):
        if field == 1:
            x = coded(1, rows[i][0].encode()) + coded(2, rows[i][1]) + coded(3, rows[i][2])
            i += 1
        elif field == 2:
            x = b"".join(coded(k, v) for k, v in pieces._fields(x) if k != 3) + coded(3, 1)
        parts.append(coded(field, x))
    return b"".join(parts)


def test_viterbi_equals_the_library_but_for_ties(rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor()
    theirs.LoadFromSerializedProto(_library_twin(path))
    own = pieces.model(None)
    rng = random.Random(7)
    odd = ["".join(rng.choice("abthenrst eiou  éü日本\n\t$%&{}=0123") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts = [*odd, *(r[1] for r in rows if r[1] and len(r[1]) < 3000)]
    low = own.lowest
    cost = lambda ids: sum(low / 3 if own.types[i] == pieces.BYTE else own.scores[i] for i in ids)
    same = 0
    for text in texts:
        a, b = theirs.encode(text), own.encode(text)
        same += a == b
        assert sorted(x for x in a if own.types[x] == pieces.BYTE) == sorted(x for x in b if own.types[x] == pieces.BYTE)
        assert abs(cost(a) - cost(b)) <= 1e-5 * abs(cost(b)), text
    assert same >= 0.9 * len(texts)
