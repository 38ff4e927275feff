"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is sum((byte + 1) * B^(n - 1 - i)) modulo two primes below 2^31. The
fingerprint of a concatenation is fp(a) * B^len(b) + fp(b), so chunks are hashed on their own
and combined; texts over `huge_bytes` are cut into chunk rows that different tasks hash.
Texts with equal fingerprints are then compared byte for byte, chunk by chunk: the smallest
and the largest chunk of a group must be the same, an aggregate that combines before the
shuffle, so a hot group never meets in one task. Groups that fail (a collision) are split
by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, join_counted, materialize, slices, text_buffers

#: The two moduli (primes) and the base of the polynomials.
PRIMES = (2147483647, 2147483629)
BASE = 1000003
CHUNK = 1 << 16

_powers: dict[int, np.ndarray] = {}


def powers(p: int) -> np.ndarray:
    """BASE^0 .. BASE^CHUNK modulo p."""
    if p not in _powers:
        out, x = np.empty(CHUNK + 1, np.uint64), 1
        for i in range(CHUNK + 1):
            out[i] = x
            x = x * BASE % p
        _powers[p] = out
    return _powers[p]


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Fingerprint (h1, h2, length) of a concatenation."""
    (a1, a2, n), (b1, b2, m) = left, right
    return ((a1 * pow(BASE, m, PRIMES[0]) + b1) % PRIMES[0], (a2 * pow(BASE, m, PRIMES[1]) + b2) % PRIMES[1], n + m)


def chunk_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both polynomials of the non-empty, adjoining byte ranges [start, end) of at most CHUNK bytes."""
    data = raw[starts[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    lens = ends - starts
    left = np.repeat(ends - starts[0], lens) - np.arange(len(data)) - 1
    heads = starts - starts[0]
    return tuple(np.add.reduceat(data * powers(p)[left], heads) % np.uint64(p) for p in PRIMES)


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of consecutive texts, combined from their chunks."""
    n = len(offsets) - 1
    out = np.zeros((2, n), np.int64)
    lens = np.diff(offsets)
    pieces = -(-lens // CHUNK)
    if not pieces.sum():
        return out[0], out[1]
    owner = np.repeat(np.arange(n), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[owner] + number * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[owner + 1])
    h1, h2 = chunk_hashes(raw, starts, ends)
    single = pieces[owner] == 1
    out[0, owner[single]], out[1, owner[single]] = h1[single], h2[single]
    whole: dict[int, tuple[int, int, int]] = {}
    for i in np.flatnonzero(~single):
        part = (int(h1[i]), int(h2[i]), int(ends[i] - starts[i]))
        d = int(owner[i])
        whole[d] = combine(whole[d], part) if d in whole else part
    for d, (a, b, _) in whole.items():
        out[0, d], out[1, d] = a, b
    return out[0], out[1]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(batch.column("_text"))
        h1, h2 = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for a, b in slices(offsets):
            h1[a:b], h2[a:b] = fingerprints(raw, offsets[a : b + 1])
        view = memoryview(raw)
        sha = [hashlib.sha256(view[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_d"), batch.column("_t"), batch.column("_id"), pa.array(h1), pa.array(h2), pa.array(np.diff(offsets)), pa.array(sha)],
            ["_d", "_t", "_id", "h1", "h2", "n_bytes", "text_sha256"],
        )


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(0, 0) for _ in range(len(batch))]
        for i, piece in enumerate(batch.column("_piece").to_pylist()):
            raw = np.frombuffer(piece, np.uint8)
            a, b = chunk_hashes(raw, np.array([0]), np.array([len(raw)]))
            found[i] = (int(a[0]), int(b[0]))
        sizes = [len(x) for x in batch.column("_piece").to_pylist()]
        cols = [batch.column("_d"), batch.column("_t"), batch.column("_no"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())]
        cols += [pa.array([pow(BASE, n, p) for n in sizes], pa.int64()) for p in PRIMES]
        yield pa.RecordBatch.from_arrays(cols, ["_d", "_t", "_no", "a", "b", "pa", "pb"])


def _pieces(df: DataFrame, *keep: str) -> DataFrame:
    """Rows (kept columns, _no, _piece): the UTF-8 bytes in chunks; an empty text has one empty chunk."""
    raw = df.withColumn("_raw", F.encode("_text", "UTF-8"))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"int((octet_length(_raw) - 1) div {CHUNK})")))
    return raw.select(*keep, "_raw", F.explode(at).alias("_no")).select(*keep, "_no", F.expr(f"substring(_raw, _no * {CHUNK} + 1, {CHUNK})").alias("_piece"))


def fingerprint_table(docs: DataFrame, huge_bytes: int = 1 << 24) -> DataFrame:
    """_d, _t, _id, h1, h2, n_bytes, text_sha256 of every document."""
    keyed = identified(docs)
    schema = "_d long, _t long, _id long, h1 long, h2 long, n_bytes long, text_sha256 string"
    short = keyed.where(F.octet_length("_text") <= huge_bytes).mapInArrow(_fingerprint_batches, schema)
    long = keyed.where(F.octet_length("_text") > huge_bytes)
    parts = _pieces(long.dropDuplicates(["_d", "_t"]), "_d", "_t").repartition("_d", "_t", "_no").mapInArrow(_chunk_batches, "_d long, _t long, _no int, a long, b long, pa long, pb long")
    rows = parts.groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct("_no", "a", "b", "pa", "pb"))).alias("_parts"))
    fold = lambda h, w, p: F.aggregate("_parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[w] + x[h]) % p)
    whole = rows.select("_d", "_t", fold("a", "pa", PRIMES[0]).alias("h1"), fold("b", "pb", PRIMES[1]).alias("h2"))
    sizes = long.select("_d", "_t", "_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.encode("_text", "UTF-8"), 256).alias("text_sha256"))
    return short.unionByName(whole.join(sizes, ["_d", "_t"]))


def exact_groups(docs: DataFrame, huge_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes for every row.

    Texts are equal when identical; null is the empty text, and empty texts are equal. The
    largest doc_id of a group stays (null ids rank below all); rows repeating that id and
    text all count as kept. Any other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprint_table(docs, huge_bytes), "fingerprints")
    fp = ["h1", "h2", "n_bytes"]
    groups = materialize(prints.groupBy(*fp).agg(F.count("*").alias("_n")).where("_n > 1"), "fingerprint-groups")
    members = join_counted(prints, groups, fp).select("_d", "_t", *fp).distinct()
    bodies = identified(docs).join(members, ["_d", "_t"])
    chunks = _pieces(bodies, *fp).groupBy(*fp, "_no").agg(F.min("_piece").alias("_lo"), F.max("_piece").alias("_hi"))
    split = chunks.groupBy(*fp).agg(F.min(F.col("_lo") == F.col("_hi")).alias("_same")).where(~F.col("_same"))
    marked = prints.join(split, fp, "left").withColumn("_variant", F.when(F.col("_same").isNotNull(), F.col("text_sha256")).otherwise(F.lit("")))
    marked = materialize(marked.select("_id", *fp, "_variant", "text_sha256"), "fingerprint-variants")
    key = [*fp, "_variant"]
    sets = materialize(marked.groupBy(*key).agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("_n", F.col("group_size")), "fingerprint-sets")
    return join_counted(marked, sets, key).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes"
    )
