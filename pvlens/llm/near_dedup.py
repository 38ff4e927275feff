"""MinHash near-dedup by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set of word five-grams, the weight being how often a gram comes. Each
unit of weight of an element is a region of width 1 along a rank axis on which darts fall as a
Poisson process seeded by (element, unit) alone: every document that holds the region sees the
same darts. A document of weight W takes the darts of rank below t / W, about t in all; each
dart names one of k coordinates, and the earliest dart of a coordinate is its signature there.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Bands of the signature put texts in buckets. A bucket's members meet one leader each (another
random one in every band), which is linear in the bucket; links are verified exactly on the
texts. What the leaders leave open, members of one bucket in different components, is then
compared as well, so no link between texts that share a bucket is lost: pair by pair in small
buckets, and block against block (sparse matrix products over packed sets, of which only the
links that join components come out) in large ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, gram_hashes, identified, join_counted, keys, materialize, mix, release, slices, text_buffers, word_hashes

SHINGLE = 5


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, gram, weight) of consecutive texts; a text of fewer than n words is one gram."""
    h, _, _, bounds = word_hashes(raw, offsets)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    grams = gram_hashes(h, n)
    inside = np.arange(len(grams)) + n <= bounds[owner[: len(grams)] + 1] if len(grams) else np.zeros(0, bool)
    doc, gram = owner[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        mult = keys(n, 77)
        whole = np.array([(h[bounds[i] : bounds[i + 1]] * mult[: counts[i]]).sum(dtype=U64) + U64(int(counts[i])) for i in short], U64)
        doc, gram = np.concatenate([doc, short]), np.concatenate([gram, mix(whole)])
    if not len(doc):
        return doc.astype(np.int64), gram, np.zeros(0, np.int64)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], gram[heads], np.diff(np.append(heads, len(doc)))


_ROUND = keys(1, 901)[0]


def _gap(state: np.ndarray) -> np.ndarray:
    """Exponential gaps of mean 1 from 64-bit hashes."""
    return -np.log(((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def dart_signatures(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = 0) -> np.ndarray:
    """(n_docs, k) uint64 signatures; documents without elements have zeros.

    weight may be fractional: the last unit of an element is hit only by darts whose own
    weight coordinate lies below the fraction.
    """
    out = np.zeros((n_docs, k), U64)
    if not len(doc):
        return out
    units = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), units)
    unit = np.arange(len(row)) - np.repeat(np.cumsum(units) - units, units)
    region = mix(gram[row] + unit.astype(U64) * keys(1, 17 + seed)[0])
    share = np.minimum(1.0, weight[row] - unit)
    owner = doc[row]
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    darts = k * (np.log(k) + 2.0)
    open_docs = total > 0
    while open_docs.any():
        limit = np.where(open_docs, darts / np.maximum(total, 1e-300), 0.0)
        at = np.flatnonzero(open_docs[owner])
        rank = np.zeros(len(at))
        turn, found = 0, []
        while len(at):
            dart = mix(region[at] + U64((turn + 1) * int(_ROUND) % (1 << 64)))
            rank = rank + _gap(dart)
            live = rank < limit[owner[at]]
            at, rank, dart = at[live], rank[live], dart[live]
            hit = dart
            if len(at):
                place = mix(dart + U64(0x51))
                below = (mix(dart + U64(0x52)) >> U64(11)).astype(np.float64) * 2.0**-53 < share[at]
                found.append((owner[at][below], (place[below] % U64(k)).astype(np.int64), rank[below], hit[below]))
            turn += 1
        if found:
            d, c, r, h = (np.concatenate([f[i] for f in found]) for i in range(4))
            order = np.lexsort((r, c, d))
            d, c, h = d[order], c[order], h[order]
            lead = np.ones(len(d), bool)
            lead[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
            got = np.zeros((n_docs, k), bool)
            got[d[lead], c[lead]] = True
            out[d[lead], c[lead]] = h[lead]
            open_docs &= ~got.all(axis=1)
        darts *= 2  # a coordinate without a dart: throw twice as many
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) int64 keys of consecutive groups of `rows` coordinates."""
    n, k = signatures.shape
    grouped = signatures.reshape(n, k // rows, rows)
    out = np.zeros(grouped.shape[:2], U64)
    for j, m in enumerate(keys(rows, 333)):
        out += grouped[:, :, j] * m
    return mix(out + np.arange(k // rows, dtype=U64)[None, :] * keys(1, 555)[0]).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard of two (sorted grams, weights)."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)


def one_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = text.encode()
    _, gram, weight = shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return gram, weight


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("_text"))
            for a, b in slices(offsets):
                doc, gram, weight = shingles(raw, offsets[a : b + 1])
                some = np.zeros(b - a, bool)
                some[doc] = True
                marks = band_keys(dart_signatures(doc, gram, weight, b - a, bands * rows), rows)
                rows_at = np.flatnonzero(some)
                flat = pa.array(marks[rows_at].ravel())
                ends = pa.array(np.arange(len(rows_at) + 1, dtype=np.int32) * bands)
                nodes = batch.column("_node").slice(a, b - a).take(pa.array(rows_at))
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(ends, flat)], ["_node", "_bands"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            same = []
            for i in range(len(batch)):
                key = batch.column("_b")[i].as_py()
                if key != last_key:
                    last_key, last = key, one_set(batch.column("_text_b")[i].as_py())
                same.append(similarity(one_set(batch.column("_text_a")[i].as_py()), last))
            keep = pa.array([x >= threshold for x in same])
            yield pa.RecordBatch.from_arrays([batch.column("_a").filter(keep), batch.column("_b").filter(keep), pa.array(same).filter(keep)], ["_a", "_b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (_a, _b) whose texts reach the threshold, with their similarity."""
    a = texts.select(F.col("_node").alias("_a"), F.col("_text").alias("_text_a"))
    b = texts.select(F.col("_node").alias("_b"), F.col("_text").alias("_text_b"))
    return pairs.join(a, "_a").join(b, "_b").select("_a", "_b", "_text_a", "_text_b").mapInArrow(_verify(threshold), "_a binary, _b binary, similarity double")


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [one_set(t) for t in batch.column("_text").to_pylist()]
        grams = pa.array([g.astype("<u8").tobytes() for g, _ in sets], pa.binary())
        weights = pa.array([w.astype("<i8").tobytes() for _, w in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_node"), grams, weights], ["_node", "_grams", "_weights"])


def block_links(a: list[dict], b: list[dict], threshold: float, same: bool) -> list[tuple[bytes, bytes]]:
    """Links between two blocks of packed sets that join components not joined yet.

    Common weight is the number of shared (gram, unit) cells, a product of 0/1 matrices over
    the cells that both blocks hold.
    """

    def cells(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, key, total = [], [], []
        for i, r in enumerate(rows):
            g, w = np.frombuffer(r["_grams"], "<u8"), np.frombuffer(r["_weights"], "<i8")
            unit = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            key.append(mix(np.repeat(g, w) + unit.astype(U64) * keys(1, 4321)[0]))
            owner.append(np.full(len(unit), i))
            total.append(len(unit))
        return np.concatenate(owner), np.concatenate(key), np.array(total)

    (oa, ka, ta), (ob, kb, tb) = cells(a), cells(b)
    shared = np.intersect1d(ka, kb)
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        m, n = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        for o, k, out in ((oa, ka, m), (ob, kb, n)):
            j = np.minimum(np.searchsorted(part, k), len(part) - 1)
            hit = part[j] == k
            out[o[hit], j[hit]] = 1
        common += m @ n.T
    near = common.astype(np.float64) >= threshold * (ta[:, None] + tb[None, :] - common.astype(np.float64)) - 1e-9
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    out = []
    for i, j in zip(*np.nonzero(near)):
        if same and i >= j:
            continue
        x, y = find(a[i]["_root"]), find(b[j]["_root"])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a[i]["_node"], b[j]["_node"]))
    return out


def linked_in_blocks(members: DataFrame, sets: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """_a, _b: links that join the components of members (_band, _key, _n, _node, _root) of one bucket.

    A bucket is dealt into blocks of about `block_rows` by hash; a pair of blocks is one row, so a
    large bucket spreads over many tasks and its pairs never leave a task.
    """
    blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    dealt = members.join(sets, "_node").withColumn("_blk", F.pmod(F.xxhash64("_node", F.lit("block")), blocks).cast("int"))
    packed = materialize(dealt.groupBy("_band", "_key", "_blk").agg(F.collect_list(F.struct("_node", "_root", "_grams", "_weights")).alias("_rows")), "set-blocks")
    ids = packed.select("_band", "_key", "_blk")
    pairs = ids.withColumnRenamed("_blk", "_i").join(ids.withColumnRenamed("_blk", "_j"), ["_band", "_key"]).where("_i <= _j")
    left = packed.select("_band", "_key", F.col("_blk").alias("_i"), F.col("_rows").alias("_ra"))
    right = packed.select("_band", "_key", F.col("_blk").alias("_j"), F.col("_rows").alias("_rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                same = batch.column("_i")[i].as_py() == batch.column("_j")[i].as_py()
                found = block_links(batch.column("_ra")[i].as_py(), batch.column("_rb")[i].as_py(), threshold, same)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["_a", "_b"])

    both = pairs.join(left, ["_band", "_key", "_i"]).join(right, ["_band", "_key", "_j"]).repartition("_band", "_key", "_i", "_j")
    return both.select("_i", "_j", "_ra", "_rb").mapInArrow(run, "_a binary, _b binary")


def components(edges: DataFrame) -> DataFrame:
    """_node, _root of the connected components of (_a, _b).

    Each round hooks every node to the smallest node around it and contracts. Node keys are
    hashes, so a round removes a constant share of the nodes whatever the shape. Only written
    tables carry over from round to round; nothing is collected but a count.
    """
    links = materialize(edges.select("_a", "_b").where("_a <> _b").distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.select(F.col("_a").alias("_node"), F.col("_b").alias("_other")).unionByName(links.select(F.col("_b").alias("_node"), F.col("_a").alias("_other")))
        hook = materialize(both.groupBy("_node").agg(F.min("_other").alias("_m")).select("_node", F.least("_node", "_m").alias("_root")), "hooks")
        if roots is None:
            further = hook
        else:
            step = hook.select(F.col("_node").alias("_root"), F.col("_root").alias("_next"))
            further = materialize(roots.join(step, "_root", "left").select("_node", F.coalesce("_next", "_root").alias("_root")), "roots")
        left = hook.select(F.col("_node").alias("_a"), F.col("_root").alias("_ra"))
        right = hook.select(F.col("_node").alias("_b"), F.col("_root").alias("_rb"))
        moved = links.join(left, "_a").join(right, "_b").where("_ra <> _rb").select(F.least("_ra", "_rb").alias("_a"), F.greatest("_ra", "_rb").alias("_b")).distinct()
        before, links = links, materialize(moved, "links")
        release(before, *([] if roots is None else [roots, hook]))
        roots = further
    return roots if roots is not None else links.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))


def text_key(text: Column) -> Column:
    """The first 16 bytes of the text's SHA-256: no two texts are known or can be made to share them."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, bands: int = 25, rows: int = 5, small_bucket: int = 32, block_rows: int = 128, with_key: bool = False) -> DataFrame:
    """doc_id, class_id, kept (and text_key, if asked for) for every row: class_id is the smallest doc_id of the group, whose text stays.

    Groups are the connected components of texts with weighted Jaccard similarity of five-word
    shingles of at least `threshold`; equal texts are one node, so copies are never paired.
    With 25 bands of 5, a pair at 0.8 meets in a bucket with probability 0.99995. Texts
    without words group only with equal texts; null counts as empty; null ids rank above all, so
    class_id is null only where all ids of the group are. One (doc_id, text) of a group is kept,
    the smallest; rows that repeat it cannot be told apart and all count as kept. Other columns
    are ignored; an empty table gives no rows.
    """
    nodes = identified(docs).select("_d", "_id", text_key(F.col("_text")).alias("_node"), "_text")
    named = materialize(nodes.select("_d", "_id", "_node"), "nodes")
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id"))
    first = materialize(named.groupBy("_node").agg(F.min("_d").alias("_d"), least.alias("_least"), F.count("*").alias("_n")), "texts-named")
    signed = nodes.select("_node", "_text").mapInArrow(_sign(bands, rows), "_node binary, _bands array<long>")
    member = signed.select("_node", F.posexplode("_bands").alias("_band", "_key")).distinct()
    member = materialize(member, "bands")
    order = F.xxhash64("_node", "_band")
    lead = member.groupBy("_band", "_key").agg(F.min(F.struct(order.alias("o"), "_node")).alias("_lead"), F.count("*").alias("_n")).where("_n > 1").select("_band", "_key", F.col("_lead._node").alias("_b"), "_n")
    lead = materialize(lead, "leaders")
    met = join_counted(member, lead, ["_band", "_key"]).where("_node <> _b")
    pairs = materialize(met.select(F.least("_node", "_b").alias("_a"), F.greatest("_node", "_b").alias("_b")).distinct(), "pairs")
    # One row a distinct text: the row of its smallest id. Rows that repeat id and text are dropped with it.
    wanted = pairs.select(F.explode(F.array("_a", "_b")).alias("_node")).distinct().join(first.select("_node", "_d"), "_node")
    texts = materialize(nodes.join(wanted, ["_node", "_d"]).select("_node", "_text").dropDuplicates(["_node"]), "texts")
    links = materialize(verified(pairs, texts, threshold), "verified")
    roots = components(links)
    # Members of one bucket that are still apart: compare them too, but for the pairs tried.
    at = member.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    apart = at.groupBy("_band", "_key").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi and _n > 2").select("_band", "_key", "_n")
    left = materialize(at.join(apart, ["_band", "_key"]), "apart")
    if not left.isEmpty():
        open_nodes = left.select("_node").distinct().join(first.select("_node", "_d"), "_node")
        open_texts = materialize(nodes.join(open_nodes, ["_node", "_d"]).select("_node", "_text").dropDuplicates(["_node"]), "texts-apart")
        small = left.where(F.col("_n") <= small_bucket)
        other = small.select("_band", "_key", F.col("_node").alias("_b"), F.col("_root").alias("_rb"))
        rest = small.withColumnRenamed("_node", "_a").join(other, ["_band", "_key"]).where("_a < _b and _root <> _rb").select("_a", "_b").distinct().join(pairs, ["_a", "_b"], "left_anti")
        found = verified(rest, open_texts, threshold).select("_a", "_b")
        sets = open_texts.mapInArrow(_pack_sets, "_node binary, _grams binary, _weights binary")
        found = materialize(found.unionByName(linked_in_blocks(left.where(F.col("_n") > small_bucket), sets, threshold, block_rows)), "links-apart")
        if not found.isEmpty():
            roots = components(links.select("_a", "_b").unionByName(found))
    # Classes are found over distinct texts and only then given to the rows.
    rooted = materialize(first.join(roots, "_node", "left").select("_node", "_least", "_n", F.coalesce("_root", "_node").alias("_root")), "rooted")
    classes = rooted.groupBy("_root").agg(F.min(F.struct("_least", "_node")).alias("_best"), F.count("*").alias("_n"))
    classes = materialize(classes, "classes")
    classed = join_counted(rooted.withColumnRenamed("_n", "_rows"), classes, ["_root"])
    classed = materialize(classed.select("_node", "_best", F.col("_rows").alias("_n")), "classed")
    out = join_counted(named.select("_id", "_node"), classed, ["_node"])
    best = F.col("_best._least._id")
    kept = (F.col("_node") == F.col("_best._node")) & F.col("_id").eqNullSafe(best)
    return out.select(F.col("_id").alias("doc_id"), best.alias("class_id"), kept.alias("kept"), *[F.col("_node").alias("text_key")] * with_key)
