"""Periodic runs of words: harmonic grid, prefix hashes, longest common extensions.

A run of period p and exponent k or more makes words p apart equal over (k - 1) p places in a row, so
one of them is a multiple of (k - 1) p. The pairs (grid point, grid point + p) of all periods number
n ln n / (k - 1). Those whose words differ fall away; the common extensions of the others, to both
sides, are found by one binary search over all of them at once, on prefix hashes modulo 2^61 - 1.
Equal texts have equal hashes, so a hash may only make a run too long: every run's words are
compared, and a run that fails makes its texts start again with another base.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, mix, slices, text_buffers

PRIME = U64((1 << 61) - 1)
PAIRS = 1 << 20
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, of residues."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = a0 * b1 + a1 * b0
    return _fold(((a1 * b1) << U64(1)) + (middle >> U64(30)) + ((middle & _LOW30) << U64(31)) + a0 * b0)


def powers(base: np.ndarray, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1), doubled until there are enough."""
    out = np.ones(max(n, 1), U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], times(out[done - 1 : done], base))
        done += more
    return out


class Prefixes:
    """Hashes of all stretches of a row of word numbers."""

    def __init__(self, ids: np.ndarray, seed: int):
        self.power = powers(mix(np.array([seed + 1], U64)) % PRIME, len(ids) + 1)
        terms = times(_fold(mix(ids.astype(U64) + U64(1))), self.power[: len(ids)])
        low, high = np.cumsum(terms & _LOW31), np.cumsum(terms >> U64(31))
        self.sums = np.zeros(len(ids) + 1, U64)
        self.sums[1:] = _fold(_fold(low) + (((high << U64(31)) & PRIME) | (high >> U64(30))))

    def same(self, i: np.ndarray, length: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Are the words [i, i + length) those [i + step, i + step + length)?"""
        own = _fold(self.sums[i + length] + PRIME - self.sums[i])
        other = _fold(self.sums[i + step + length] + PRIME - self.sums[i + step])
        return times(own, self.power[step]) == other


def extend(hashes: Prefixes, i: np.ndarray, step: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How far the words from i on (or, with back, before i) equal those `step` further, at most `most`; one binary search for all."""
    got = np.zeros(len(i), np.int64)
    bit = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
    while bit and len(i):
        longer = np.minimum(got + bit, most)
        live = np.flatnonzero(longer == got + bit)
        at = i[live] - longer[live] if back else i[live]
        equal = hashes.same(at, longer[live], step[live])
        got[live[equal]] = longer[live[equal]]
        bit >>= 1
    return got


def find_runs(ids: np.ndarray, bounds: np.ndarray, exponent: int = 4, least: int = 6, seed: int = 0) -> np.ndarray:
    """(text, start, length, period) of every run of the texts ids[bounds[t]:bounds[t + 1]], ordered by text, start, period.

    A run has a length of at least max(least, exponent * period) and cannot be extended; its period is the smallest.
    """
    sizes = np.diff(bounds)
    periods = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stride = period * (exponent - 1)
    points = (sizes[text] - period - 1) // stride + 1
    ends = np.cumsum(points)
    hashes, found = None, []
    # Of each word, the period and the end of a run known to cover it: pairs inside it, a multiple of its period apart, lead to it again.
    covered, until = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(a, b), points[a:b])
        nth = np.arange(len(own)) - np.repeat(ends[a:b] - points[a:b] - (ends[a - 1] if a else 0), points[a:b])
        i, p, t = bounds[text[own]] + nth * stride[own], period[own], text[own]
        hit = np.flatnonzero(ids[i] == ids[i + p])
        i, p, t = i[hit], p[hit], t[hit]
        new = (covered[i] == 0) | (i + p >= until[i])
        new[~new] = p[~new] % covered[i[~new]] != 0
        i, p, t = i[new], p[new], t[new]
        a = b
        if not len(i):
            continue
        hashes = hashes or Prefixes(ids, seed)
        after = extend(hashes, i, p, bounds[t + 1] - i - p, False)
        before = extend(hashes, i, p, i - bounds[t], True)
        start, length = i - before, before + after + p
        long = length >= np.maximum(least, exponent * p)
        rows = np.unique(np.stack([t[long], start[long], length[long], p[long]], 1), axis=0)
        if not len(rows):
            continue
        heads = np.flatnonzero(np.r_[True, (rows[1:, 1:3] != rows[:-1, 1:3]).any(1)])  # of each stretch, the smallest period
        smallest = np.repeat(rows[heads, 3], np.diff(np.r_[heads, len(rows)]))
        true = not (rows[:, 3] % smallest).any()
        for _, s, n, q in rows[heads].tolist():
            true = true and np.array_equal(ids[s : s + n - q], ids[s + q : s + n])
            covered[s : s + n], until[s : s + n] = q, s + n
        if not true:
            return find_runs(ids, bounds, exponent, least, seed + 1)
        found.append(rows[heads])
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, 1:3] != rows[:-1, 1:3]).any(1)]]  # found again in a later block, by a multiple
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 1] -= bounds[rows[:, 0]]
    return rows


def sharpest(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, ties to the smallest start, then period; compared without rounding."""
    best = None
    for s, n, q in runs:
        if best is None or (gap := n * best[2] - best[1] * q) > 0 or (gap == 0 and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    return best


def collapse(words: list[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without what each run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for s, n, q in runs:
            kept[s + q : s + n] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, runs, start, length, period, collapsed_text, kept columns; a row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. runs: array of (start, length, period) by start, then
    period; start, length, period are those of the sharpest run, null without a run. rewrite may change
    the words of a document (by doc_id) before the search. A null or empty text has no words; repeated rows
    are searched each; rows without an id too; an empty table gives no rows. Other columns are left out, so
    their names cannot clash. Texts are searched in slices of a megabyte, a longer one by itself: about 100
    bytes a word, and n ln n pairs in blocks of a million.
    """
    if exponent < 2:
        raise ValueError("runs of an exponent below 2 are not found by this grid")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("_text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in slices(offsets, SLICE_BYTES):
                texts = []
                for k in range(a, b):
                    words = raw[offsets[k] : offsets[k + 1]].tobytes().split()  # at the six blanks of ASCII
                    texts.append(rewrite(doc_ids[k], words) if rewrite else words)
                bounds = np.zeros(b - a + 1, np.int64)
                np.cumsum([len(w) for w in texts], out=bounds[1:])
                number = defaultdict(count().__next__)  # equal words, equal numbers
                ids = np.fromiter((number[w] for words in texts for w in words), np.int64, int(bounds[-1]))
                own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for t, s, n, q in find_runs(ids, bounds, exponent, least).tolist():
                    own[t].append((s, n, q))
                best = [sharpest(runs) or (None, None, None) for runs in own]
                columns = {"doc_id": batch.column("doc_id").slice(a, b - a), "n_words": pa.array(np.diff(bounds))}
                columns["runs"] = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in own], run_type)
                columns |= {name: pa.array([x[k] for x in best], pa.int64()) for k, name in enumerate(("start", "length", "period"))}
                columns["collapsed_text"] = pa.array([collapse(words, runs) for words, runs in zip(texts, own)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns | {f"_keep_{i}": batch.column(f"_keep_{i}").slice(a, b - a) for i in range(len(keep))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    kept = "".join(f", _keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, collapsed_text string"
    found = rows.mapInArrow(search, schema + kept)
    return found.select("doc_id", "n_words", "runs", "start", "length", "period", "collapsed_text", *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)))
