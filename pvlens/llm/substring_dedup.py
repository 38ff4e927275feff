"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Index: winnowing picks gram anchors so that every window of `window` words holds at least one,
chosen by its own words. An anchor that comes more than once has its first place in the
corpus, by (doc_id, text hash, position), as its reference. The words around the references,
as hashes in blocks, are what documents are factored against.
Parse: a document walks over its anchors and extends each match with the reference text in
both directions, greedily; a factor of `window` words or more is a duplicate span, in the
document and in the reference.
Boundaries: a window that no long factor covers can still equal another such window. As equal
windows choose the same anchor, and so the same reference, it can only equal windows that are
left over too: those are compared by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, identified, identity, join_counted, materialize, slices, text_buffers, word_hashes

GRAM = 10
BLOCK = 64


def anchors(grams: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of one text, the gram it chooses: the leftmost smallest of its grams."""
    width = window - gram + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        own = grams[j : j + n]
        less = own < best
        best[less] = own[less]
        at[less] = j
    return at + np.arange(n)


def _anchor_batches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("_text"))
            for a, b in slices(offsets):
                h, _, _, bounds = word_hashes(raw, offsets[a : b + 1])
                counts = np.diff(bounds)
                grams = gram_hashes(h, gram)
                chosen = anchors(grams, window, gram)  # over all texts; windows across texts go
                owner = np.repeat(np.arange(b - a), counts)
                starts = np.arange(len(chosen))
                inside = starts + window <= bounds[owner[: len(chosen)] + 1] if len(chosen) else np.zeros(0, bool)
                at = np.unique(chosen[inside])
                doc = owner[at]
                took = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_d").take(took), batch.column("_t").take(took), pa.array((at - bounds[doc]).astype(np.int32)), pa.array(grams[at].view(np.int64))], ["_d", "_t", "_p", "_h"]
                )

    return run, "_d long, _t long, _p int, _h long"


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted blocks of word hashes of reference documents."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column("_text"))
        wanted = batch.column("_blocks").to_pylist()
        for i, own in enumerate(wanted):
            h = word_hashes(raw, offsets[i : i + 2])[0].astype("<u8")
            cells = [h[b["_k"] * BLOCK : (b["_k"] + 1) * BLOCK].tobytes() for b in own]
            took = pa.array([i] * len(own), pa.int64())
            columns = [batch.column("_d").take(took), batch.column("_t").take(took), pa.array([b["_k"] for b in own], pa.int32()), pa.array([b["_n"] for b in own], pa.int64()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_rd", "_rt", "_k", "_n", "_cells"])


def factor(h: np.ndarray, found: list[tuple[int, tuple, int]], blocks: dict[tuple, dict[int, np.ndarray]], window: int, gram: int) -> tuple[list[list], list[int]]:
    """Factors [start, end, reference, reference start] of one text, and each anchor's factor (-1: none).

    found: (position, reference document, reference position) in ascending position. A match
    is extended as far as its anchor's windows reach, and joins the factor before it where
    that lies on the same reference and diagonal.
    """
    reach = window - gram
    out: list[list] = []
    of: list[int] = []

    def reference(own: dict[int, np.ndarray], a: int, b: int) -> np.ndarray:
        parts, at = [], a
        while at < b and (cell := own.get(at // BLOCK)) is not None:
            part = cell[at % BLOCK : at % BLOCK + b - at]
            parts.append(part)
            at += len(part)
            if not len(part) or at % BLOCK:
                break
        return np.concatenate(parts) if parts else np.zeros(0, "<u8")

    def agreed(mine: np.ndarray, other: np.ndarray) -> int:
        n = min(len(mine), len(other))
        differs = np.flatnonzero(mine[:n] != other[:n])
        return int(differs[0]) if len(differs) else n

    for p, ref, q in found:
        own = blocks.get(ref, {})
        right = reference(own, q, q + gram + reach)
        n_right = agreed(h[p : p + len(right)], right)
        if n_right < gram:  # a collision of gram hashes
            of.append(-1)
            continue
        back = min(reach, p, q)
        left = reference(own, q - back, q)
        n_left = agreed(h[p - back : p][::-1], left[::-1]) if len(left) == back else 0
        last = out[-1] if out else None
        if last and last[2] == ref and last[0] - last[3] == p - q and p - n_left <= last[1]:
            last[1] = max(last[1], p + n_right)
        else:
            out.append([p - n_left, p + n_right, ref, q - n_left])
        of.append(len(out) - 1)
    return out, of


def _parse_batches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column("_text"))
            spans, refs, left = [], [], []
            for i in range(len(batch)):
                h = word_hashes(raw, offsets[i : i + 2])[0]
                mine = batch.column("_anchors")[i].as_py()
                cells: dict[tuple, dict[int, np.ndarray]] = {}
                for c in batch.column("_cells")[i].as_py() or ():
                    cells.setdefault((c["_rd"], c["_rt"]), {})[c["_k"]] = np.frombuffer(c["_cells"], "<u8")
                mine.sort(key=lambda m: m["_p"])
                found = [(m["_p"], (m["_rd"], m["_rt"]), m["_q"]) for m in mine if not m["_own"]]
                factors, of = factor(h, found, cells, window, gram)
                own_spans, own_refs = [], set()
                for start, end, ref, q in factors:
                    if end - start >= window:
                        own_spans.append((start, end))
                        own_refs.add((*ref, q, q + end - start))
                # Windows that the factor of the anchor they chose does not cover.
                lo, hi = np.zeros(len(h) + 1, np.int64), np.full(len(h) + 1, -1, np.int64)
                asked = np.zeros(len(h) + 1, bool)
                for (p, _, _), f in zip(found, of):
                    asked[p] = True
                    if f >= 0:
                        lo[p], hi[p] = factors[f][0], factors[f][1]
                chosen = anchors(gram_hashes(h, gram), window, gram)
                starts = np.arange(len(chosen))
                covered = (lo[chosen] <= starts) & (starts + window <= hi[chosen])
                open_at = np.flatnonzero(asked[chosen] & ~covered)
                one, two = gram_hashes(h, window, 5), gram_hashes(h, window, 9)
                spans.append([x for span in own_spans for x in span])
                refs.append([{"_rd": r[0], "_rt": r[1], "_s": r[2], "_e": r[3]} for r in sorted(own_refs)])
                left.append([{"_w": int(w), "_x": int(one[w].view(np.int64)), "_y": int(two[w].view(np.int64))} for w in open_at])
            ref_type = pa.list_(pa.struct([("_rd", pa.int64()), ("_rt", pa.int64()), ("_s", pa.int32()), ("_e", pa.int32())]))
            left_type = pa.list_(pa.struct([("_w", pa.int32()), ("_x", pa.int64()), ("_y", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d"), batch.column("_t"), pa.array(spans, pa.list_(pa.int32())), pa.array(refs, ref_type), pa.array(left, left_type)], ["_d", "_t", "_spans", "_refs", "_left"]
            )

    return run, "_d long, _t long, _spans array<int>, _refs array<struct<_rd:long,_rt:long,_s:int,_e:int>>, _left array<struct<_w:int,_x:long,_y:long>>"


def duplicate_spans(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """_d, _t, _spans of the documents that hold a window found elsewhere; spans are word ranges."""
    keyed = identified(docs).drop("_id")
    run, schema = _anchor_batches(window, gram)
    places = materialize(keyed.mapInArrow(run, schema), "anchors")
    index = places.groupBy("_h").agg(F.min(F.struct("_d", "_t", "_p")).alias("_r"), F.count("*").alias("_n")).where("_n > 1")
    index = materialize(index, "anchor-index")
    own = (F.col("_d") == F.col("_r._d")) & (F.col("_t") == F.col("_r._t")) & (F.col("_p") == F.col("_r._p"))
    met = join_counted(places, index, ["_h"]).select("_d", "_t", "_p", F.col("_r._d").alias("_rd"), F.col("_r._t").alias("_rt"), F.col("_r._p").alias("_q"), own.alias("_own"))
    shared = materialize(met.distinct(), "shared-anchors")
    reach = window - gram
    lo, hi = F.expr(f"int(greatest(0, _q - {reach}) div {BLOCK})"), F.expr(f"int((_q + {window - 1}) div {BLOCK})")
    needs = shared.where("not _own").select("_d", "_t", "_rd", "_rt", F.explode(F.sequence(lo, hi)).alias("_k")).distinct()
    needs = materialize(needs, "block-needs")
    asked_for = needs.groupBy("_rd", "_rt", "_k").agg(F.count("*").alias("_n"))
    wanted = asked_for.groupBy(F.col("_rd").alias("_d"), F.col("_rt").alias("_t")).agg(F.collect_list(F.struct("_k", "_n")).alias("_blocks"))
    cells = keyed.join(wanted, ["_d", "_t"]).dropDuplicates(["_d", "_t"]).mapInArrow(_block_batches, "_rd long, _rt long, _k int, _n long, _cells binary")
    cells = materialize(cells, "reference-blocks")
    fetched = join_counted(needs, cells, ["_rd", "_rt", "_k"]).groupBy("_d", "_t").agg(F.collect_list(F.struct("_rd", "_rt", "_k", "_cells")).alias("_cells"))
    asked = shared.groupBy("_d", "_t").agg(F.collect_list(F.struct("_p", "_rd", "_rt", "_q", "_own")).alias("_anchors"))
    parse, parsed_schema = _parse_batches(window, gram)
    parsed = materialize(keyed.join(asked.join(fetched, ["_d", "_t"], "left"), ["_d", "_t"]).mapInArrow(parse, parsed_schema), "factors")
    pairs = F.expr("transform(sequence(0, size(_spans) - 2, 2), i -> struct(_spans[i] as _s, _spans[i + 1] as _e))")
    mine = parsed.where(F.size("_spans") > 0).select("_d", "_t", F.explode(pairs).alias("x"))
    mine = mine.select("_d", "_t", "x._s", "x._e")
    theirs = parsed.select(F.explode("_refs").alias("x")).select(F.col("x._rd").alias("_d"), F.col("x._rt").alias("_t"), "x._s", "x._e").distinct()
    open_at = parsed.select("_d", "_t", F.explode("_left").alias("x")).select("_d", "_t", "x._w", "x._x", "x._y")
    again = open_at.groupBy("_x", "_y").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    late = open_at.join(again, ["_x", "_y"]).select("_d", "_t", F.col("_w").alias("_s"), (F.col("_w") + window).alias("_e"))
    repeated = keyed.groupBy("_d", "_t").agg(F.count("*").alias("_n")).where("_n > 1").select("_d", "_t", F.lit(0).alias("_s"), F.lit(2**31 - 1).alias("_e"))
    spans = mine.unionByName(theirs).unionByName(late).unionByName(repeated)
    return spans.groupBy("_d", "_t").agg(F.collect_set(F.struct("_s", "_e")).alias("_spans"))


def kept_words(text: str, spans: list[dict] | None, window: int) -> tuple[bytes, int, int]:
    """The kept words joined by blanks, the number of words, the number removed."""
    words = text.encode().split()
    if not spans or len(words) < window:
        return b" ".join(words), len(words), 0
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["_s"]] += 1
        gone[min(s["_e"], len(words))] -= 1
    drop = np.cumsum(gone[:-1]) > 0
    return b" ".join(w for w, d in zip(words, drop) if not d), len(words), int(drop.sum())


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes when a window of `window` words over it comes
    anywhere else, in the same document too, judged on the input. Null and empty texts have no
    words. Rows repeating id and text repeat each other, so all their windows go. Texts shorter
    than a window stay whole; an empty table gives no rows; other columns are ignored.
    """
    spans = duplicate_spans(docs, window, gram)
    rows = docs.select("doc_id", *identity())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone, shas = [], [], [], []
            for text, own in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
                kept, n, m = kept_words(text, own, window)
                counts.append(n)
                gone.append(m)
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else "")
            cols = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.join(spans, ["_d", "_t"], "left").select("doc_id", "_text", "_spans").mapInArrow(run, schema)
