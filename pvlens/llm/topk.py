"""Exact top-k inner products by pivot-table elimination.

Equal vectors are one node, with the smallest ids that hold it; so a vector that many rows share
is searched once. Nodes are sorted by (nearest pivot, distance to it) and packed into blocks of
neighbours; each keeps its distances to all pivots. For a query q and a candidate x, the largest
|d(q, p) - d(x, p)| over the pivots p bounds their distance from below, and so
q.x = (|q|^2 + |x|^2 - d^2) / 2 from above. A query's own block gives a first k-th score, and with
it the range of distances to each pivot in which a candidate can reach it: blocks are joined on
the pivot and bins of that range, and pairs whose bound stays below the k-th score are dropped
from their summaries alone. The pairs that remain are dealt into cells of neighbouring blocks,
where candidates are evaluated in the order of their bounds until the next bound is below the
k-th score found. A bound equal to it is still evaluated, so ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize, smallest_hashes

#: Room left for rounding in the distances, relative to the squared norms.
SLACK = 1e-6
#: Rounding of a distance to a pivot, relative to it; a far pivot's grows beyond SLACK.
FAR_SLACK = 1e-12
#: A place in a list of the best that is still free.
NONE = -(2**63 - 1)


def quantized(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v (array<double> of floor(scale * x)); vectors that take no part are left out."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    # array<double> instead of long: exact up to 2^53, and what the matrix products need.
    return vectors.where(ok).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("double")).alias("v"))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros, which add nothing to a product."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = dim or int(lens.max(initial=0))
    out = np.zeros((len(lens), max(1, dim)))
    rows = np.repeat(np.arange(len(lens)), lens)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[rows, cols] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, those beyond a long at its ends."""
    top = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(b).T, NONE + 1, -NONE).astype(np.int64)


def choose_pivots(vectors: DataFrame, n: int, sample: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Farthest-first pivots among the `sample` vectors with the smallest hashes (a bounded sample); the sample and how many ids hold each."""
    order = F.xxhash64("_a", F.lit("pivot"))
    rows = smallest_hashes(vectors.select("_a", "_b", "v", F.size("_ids").alias("held")), order, sample).orderBy(order, "_b").limit(sample).collect()
    if not rows:
        return np.zeros((0, max(1, dim))), np.zeros((0, max(1, dim))), np.zeros(0, np.int64)
    own = np.zeros((len(rows), max(1, dim)))
    for i, r in enumerate(rows):
        own[i, : len(r.v)] = r.v
    chosen = [0]
    far = ((own - own[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((own - own[chosen[-1]]) ** 2).sum(1))
    return own[chosen], own, np.array([r.held for r in rows])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """By differences: |x|^2 + |p|^2 - 2xp would round in steps of the squared norms."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def upper_bounds(q_sq: np.ndarray, q_far: np.ndarray, x_sq: np.ndarray, x_far: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of every query with every candidate."""
    low = np.zeros((len(q_sq), len(x_sq)))
    for p in range(q_far.shape[1]):
        a, b = q_far[:, p, None], x_far[None, :, p]
        np.maximum(low, np.abs(a - b) - FAR_SLACK * (a + b), out=low)
    both = q_sq[:, None] + x_sq[None, :]
    return (both * (1 + SLACK) - (low * (1 - SLACK)) ** 2) / 2 + 1


def search(q: dict, x: dict, best: dict, chunk: int = 256) -> None:
    """Put the candidates that belong to the best of each query into `best`, in place.

    q: vectors, distances, the id that does not count (`out`, where `bar`); x: vectors, distances,
    smallest and second id of each (`one`, `two`), the number of the first (`at`). best["kth"][i]
    is a score that the last of query i's best is known to reach; it rises with what is found.
    """
    k = best["score"].shape[1]
    bounds = upper_bounds((q["v"] ** 2).sum(1), q["far"], (x["v"] ** 2).sum(1), x["far"])
    order = np.argsort(-bounds.max(axis=0), kind="stable")
    bounds = bounds[:, order]
    rest = np.maximum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
    for a in range(0, len(order), chunk):
        live = np.flatnonzero(rest[:, a] >= best["kth"])
        if not len(live):
            break
        part = order[a : a + chunk]
        scores, least = products(q["v"][live], x["v"][part]), best["kth"][live, None]
        r, c = np.nonzero((bounds[live, a : a + chunk] >= least) & (scores >= least))
        own, other = live[r], part[c]
        ids = np.where(q["bar"][own] & (x["one"][other] == q["out"][own]), x["two"][other], x["one"][other])
        some = ids != NONE
        r, c, ids, other = r[some], c[some], ids[some], other[some]
        if not len(r):
            continue
        at = np.unique(r)
        better = live[at]
        row = np.concatenate([np.repeat(at, k), r])
        score, cand, ref = (np.concatenate([best[name][better].ravel(), new]) for name, new in (("score", scores[r, c]), ("id", ids), ("ref", x["at"] + other)))
        by = np.lexsort((cand, -score, row))
        first = by[np.searchsorted(row[by], at)[:, None] + np.arange(k)]
        best["score"][better], best["id"][better], best["ref"][better] = score[first], cand[first], ref[first]
        best["kth"][better] = np.maximum(best["kth"][better], best["score"][better, -1].astype(np.float64))


def raw(x: np.ndarray) -> bytes:
    """Components as 32-bit floats where these hold them exactly, else as 64-bit ones."""
    return x.astype("<f4" if np.abs(x).max(initial=0) <= 2**24 else "<f8").tobytes()


def components_of(data: pa.Scalar, n: int, width: int) -> np.ndarray:
    buffer = data.as_buffer()
    return np.frombuffer(buffer, "<f4" if buffer.size == 4 * n * width else "<f8").reshape(n, width).astype(np.float64)


def distinct_vectors(base: DataFrame, k: int) -> DataFrame:
    """_a, _b (hashes), v, _ids: one row a distinct vector, with its k smallest ids and how often each holds it."""
    held = base.groupBy("_a", "_b", "vec_id").agg(F.count("*").alias("n"))
    few = held.withColumn("_r", F.row_number().over(Window.partitionBy("_a", "_b").orderBy("vec_id"))).where(F.col("_r") <= k)
    ids = few.groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("_ids"))  # at most k
    return base.groupBy("_a", "_b").agg(F.first("v").alias("v")).join(ids, ["_a", "_b"])


BLOCK = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("cell", pa.int32()), ("n", pa.int32()), ("near_lo", pa.float64()), ("near_hi", pa.float64()), ("data", pa.binary()), ("far", pa.binary()),
    ("held", pa.binary()), ("ids", pa.binary()), ("times", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("sq_hi", pa.float64()),
    ("nq", pa.int32()), ("qkey", pa.binary()), ("qd", pa.binary()), ("qf", pa.binary()), ("q_floor", pa.binary()), ("q_lo", pa.list_(pa.float64())), ("q_hi", pa.list_(pa.float64())), ("q_sq_hi", pa.float64()), ("q_min", pa.float64()),
])
PACKED = "part int, seq int, cell int, n int, near_lo double, near_hi double, data binary, far binary, held binary, ids binary, times binary, lo array<double>, hi array<double>, sq_hi double, nq int, qkey binary, qd binary, qf binary, q_floor binary, q_lo array<double>, q_hi array<double>, q_sq_hi double, q_min double"
QKEY = np.dtype([("a", "<i8"), ("b", "<i8"), ("out", "<i8"), ("bar", "?")])


def floors_of(q: np.ndarray, bar: np.ndarray, x: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Scores that the k-th best of each query reaches among the candidates x, each with its number of ids."""
    floors = np.full(len(q), -np.inf)
    if len(x):
        scores = products(q, x).astype(np.float64)
        order = np.argsort(-scores, axis=1)
        enough = np.cumsum(held[order] - bar[:, None], axis=1) >= k  # an id that does not count may be in each
        sure = enough.any(1)
        floors[sure] = np.take_along_axis(scores, order, 1)[sure, enough.argmax(1)[sure]]
    return floors


def pack_block(part: pa.RecordBatch, pivots: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> dict:
    """Columns of one block from its sorted rows: candidates (_q false) and queries.

    A query's first k-th score is the better one of its own block's and of the sample's.
    """
    x, asks = matrix(part.column("v"), pivots.shape[1]), part.column("_q").to_numpy(zero_copy_only=False)
    far, sq, c, q = distances(x, pivots), (x**2).sum(1), np.flatnonzero(~asks), np.flatnonzero(asks)
    out = {"cell": part.column("cell")[0].as_py(), "n": len(c), "nq": len(q)}
    lists = part.column("_ids").take(pa.array(c))
    held = np.diff(lists.offsets.to_numpy())
    if len(c):
        near, flat = part.column("near").to_numpy()[c], lists.flatten()
        out |= {"near_lo": near.min(), "near_hi": near.max(), "data": raw(x[c]), "far": far[c].astype("<f8").tobytes(), "held": held.astype("<i4").tobytes()}
        out |= {"ids": flat.field("vec_id").to_numpy().astype("<i8").tobytes(), "times": flat.field("n").to_numpy().astype("<i8").tobytes(), "lo": far[c].min(0), "hi": far[c].max(0), "sq_hi": sq[c].max()}
    if len(q):
        keys = np.zeros(len(q), QKEY)
        for name, column in (("a", "_a"), ("b", "_b"), ("out", "_x"), ("bar", "_m")):
            keys[name] = part.column(column).to_numpy(zero_copy_only=False)[q]
        floors = np.maximum(floors_of(x[q], keys["bar"], x[c], held, k), floors_of(x[q], keys["bar"], *sample, k))
        out |= {"qkey": keys.tobytes(), "qd": raw(x[q]), "qf": far[q].astype("<f8").tobytes(), "q_floor": floors.astype("<f8").tobytes(), "q_lo": far[q].min(0), "q_hi": far[q].max(0), "q_sq_hi": sq[q].max(), "q_min": floors.min()}
    return out


def block_pairs(blocks: DataFrame, bins: int) -> DataFrame:
    """(qp, qs, xp, xs): blocks of queries and blocks of candidates whose bound does not rule each other out.

    A query block asks, for each pivot (a handful of rows), the bins of candidate distances to it
    that its radius reaches; candidate blocks lie in the bins of their own nearest pivot.
    """
    cells = blocks.where("n > 0").groupBy("cell").agg(F.min("near_lo").alias("c_lo"), F.max("near_hi").alias("c_hi"), F.max("sq_hi").alias("c_sq"))
    bin_of = lambda c: F.when(F.col("c_hi") > F.col("c_lo"), F.least(F.lit(bins - 1), F.floor((c - F.col("c_lo")) / (F.col("c_hi") - F.col("c_lo")) * bins).cast("int"))).otherwise(F.lit(0))
    span = lambda lo, hi: F.explode(F.sequence(bin_of(lo), bin_of(hi))).alias("bin")
    x = blocks.where("n > 0").select(F.col("part").alias("xp"), F.col("seq").alias("xs"), "cell", "near_lo", "near_hi", "lo", "hi", "sq_hi").join(F.broadcast(cells), "cell")
    x = x.select("xp", "xs", "cell", "lo", "hi", "sq_hi", span(F.col("near_lo"), F.col("near_hi")))
    q = blocks.where("nq > 0").select(F.col("part").alias("qp"), F.col("seq").alias("qs"), "q_lo", "q_hi", "q_sq_hi", "q_min").crossJoin(F.broadcast(cells))  # one row a pivot
    radius = F.sqrt(F.greatest(F.lit(0.0), (F.col("q_sq_hi") + F.col("c_sq")) * (1 + SLACK) + 2 - 2 * F.col("q_min"))) / (1 - SLACK)
    own_lo, own_hi = F.col("q_lo")[F.col("cell")], F.col("q_hi")[F.col("cell")]
    room = radius + 2 * SLACK * (own_hi + F.col("c_hi")) + SLACK
    q = q.withColumns({"_from": own_lo - room, "_to": own_hi + room}).where("_to >= c_lo and _from <= c_hi")
    q = q.select("qp", "qs", "q_lo", "q_hi", "q_sq_hi", "q_min", "cell", span(F.greatest("_from", "c_lo"), F.least("_to", "c_hi")))
    gap = f"array_max(transform(sequence(0, size(lo) - 1), i -> greatest(0D, greatest(q_lo[i] - hi[i], lo[i] - q_hi[i]) - {FAR_SLACK} * (q_hi[i] + hi[i]))))"
    near = F.expr(f"((q_sq_hi + sq_hi) * {1 + SLACK} - pow({gap} * {1 - SLACK}, 2)) / 2 + 1 >= q_min")
    return q.join(x, ["cell", "bin"]).where(near).select("qp", "qs", "xp", "xs").distinct()


def exact_topk(vectors: DataFrame, k: int = 20, query_every: int = 20, n_pivots: int = 16, pivot_sample: int = 2048, block_rows: int = 1024, q_blocks: int = 64, x_blocks: int = 4, bins: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with other rows.

    Queries are the rows whose vec_id is divisible by `query_every`; a query meets every row
    but those with its own id, and rows that share a query's id are one query. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no part; vectors of
    different lengths meet as if ended by zeros. Equal scores go to the smaller vec_id; repeated
    rows count each. Fewer than k candidates give all of them; an empty table gives no rows.
    Scores beyond a long stay at its ends. Other columns are ignored.
    """
    base = quantized(vectors).select(F.xxhash64("v").alias("_a"), F.xxhash64(F.lit(1), "v").alias("_b"), "vec_id", "v")
    most = k + 1  # one of them may be the query's own id
    nodes = materialize(distinct_vectors(base, most), "vectors")
    width = max(1, nodes.select(F.max(F.size("v"))).first()[0] or 0)
    pivots, *sample = choose_pivots(nodes, n_pivots, pivot_sample, width)
    if not len(pivots):
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))

    # A query id with several vectors leaves its id out in the search itself (_m, _x).
    asked = base.where(F.col("vec_id") % query_every == 0).select("vec_id", "_a", "_b").distinct()
    several = asked.groupBy("vec_id").agg(F.count("*").alias("_several")).where("_several > 1")
    bar = F.col("_several").isNotNull()
    asked = materialize(asked.join(several, "vec_id", "left").select("vec_id", "_a", "_b", bar.alias("_m"), F.when(bar, F.col("vec_id")).otherwise(F.lit(0)).alias("_x")), "queries")
    by_node = materialize(asked.groupBy("_a", "_b", "_m", "_x").agg(F.count("*").alias("_n")), "query-nodes")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column("v"), width), pivots)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell]), *batch.columns], ["cell", "near", *batch.schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts, cuts[1:]):  # a block lies in one cell
                for a in range(lo, hi, block_rows):
                    own = {"part": number, "seq": seq} | pack_block(batch.slice(a, min(block_rows, hi - a)), pivots, sample, most)
                    yield pa.RecordBatch.from_pylist([own], schema=BLOCK)
                    seq += 1

    columns = ["_q", "_a", "_b", "_m", "_x", "v", "_ids"]
    candidates = nodes.select(F.lit(False).alias("_q"), "_a", "_b", F.lit(False).alias("_m"), F.lit(0).cast("long").alias("_x"), "v", "_ids")
    queries = by_node.join(nodes.select("_a", "_b", "v"), ["_a", "_b"]).select(F.lit(True).alias("_q"), "_a", "_b", "_m", F.col("_x").cast("long").alias("_x"), "v", F.lit(None).cast(nodes.schema["_ids"].dataType).alias("_ids"))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    placed = candidates.unionByName(queries).mapInArrow(place, "cell int, near double, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
    order = ["cell", "near", "_a", "_b", "_q", "_x"]
    blocks = materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, PACKED), "pivot-blocks")

    # Blocks number through all partitions, so that neighbours can share a cell of the grid: one row a partition in the window.
    sizes = blocks.groupBy("part").agg(F.count("*").alias("_c"))
    before = sizes.select("part", (F.sum("_c").over(Window.orderBy("part")) - F.col("_c")).alias("_before"))
    numbered = blocks.select("part", "seq", "n", "nq").join(before, "part").withColumn("_no", F.col("_before") + F.col("seq"))
    group = lambda size: F.floor(F.col("_no") / F.lit(size)).cast("long")
    q_group = numbered.where("nq > 0").select(F.col("part").alias("qp"), F.col("seq").alias("qs"), group(q_blocks).alias("qg"))
    x_group = numbered.where("n > 0").select(F.col("part").alias("xp"), F.col("seq").alias("xs"), group(x_blocks).alias("xg"))
    cells = materialize(block_pairs(blocks, bins).join(q_group, ["qp", "qs"]).join(x_group, ["xp", "xs"]).select("qg", "xg").distinct(), "cells")
    n_cells = max(1, min(cells.count(), 20_000))
    q_keys = q_group.join(cells, "qg").select("qp", "qs", "qg", "xg")
    x_keys = x_group.join(cells, "xg").select("xp", "xs", "qg", "xg")
    q_rows = blocks.where("nq > 0").select(F.col("part").alias("qp"), F.col("seq").alias("qs"), "nq", "qkey", "qd", "qf", "q_floor")
    x_rows = blocks.where("n > 0").select(F.col("part").alias("xp"), F.col("seq").alias("xs"), "n", "data", "far", "held", "ids", "times")
    q_side = q_rows.join(q_keys, ["qp", "qs"]).drop("qp", "qs").repartition(n_cells, "qg", "xg")
    x_side = x_rows.join(x_keys, ["xp", "xs"]).drop("xp", "xs").repartition(n_cells, "qg", "xg")
    n_far = len(pivots)

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        held, starts, ids, times = [], [np.zeros(1, np.int64)], [], []
        at = total = 0
        for r in candidates.to_batches():
            for i in range(len(r)):
                n, read = r.column("n")[i].as_py(), lambda c, kind: np.frombuffer(r.column(c)[i].as_buffer(), kind)  # noqa: B023
                own, mine = read("held", "<i4").astype(np.int64), read("ids", "<i8")
                ends = np.cumsum(own)
                two = np.where(own > 1, mine[np.minimum(ends - own + 1, len(mine) - 1)], NONE)
                held.append({"v": components_of(r.column("data")[i], n, width), "far": read("far", "<f8").reshape(n, n_far), "one": mine[ends - own], "two": two, "at": at})
                starts.append(ends + total)
                ids.append(mine)
                times.append(read("times", "<i8"))
                at, total = at + n, total + len(mine)
        edges = np.concatenate(starts)
        ids, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, times))
        out = {name: [] for name in ("_a", "_b", "_m", "_x", "score", "id", "ref")}
        for r in queries.to_batches():
            for i in range(len(r)):
                n, keys = r.column("nq")[i].as_py(), np.frombuffer(r.column("qkey")[i].as_buffer(), QKEY)
                q = {"v": components_of(r.column("qd")[i], n, width), "far": np.frombuffer(r.column("qf")[i].as_buffer(), "<f8").reshape(n, n_far), "out": keys["out"], "bar": keys["bar"]}
                best = {"score": np.full((n, most), NONE), "id": np.zeros((n, most), np.int64), "ref": np.zeros((n, most), np.int64), "kth": np.frombuffer(r.column("q_floor")[i].as_buffer(), "<f8").copy()}
                for x in held:
                    search(q, x, best)
                row, place = np.nonzero(best["score"] != NONE)
                for name, column in (("_a", "a"), ("_b", "b"), ("_m", "bar"), ("_x", "out")):
                    out[name].append(keys[column][row])
                for name in ("score", "id", "ref"):
                    out[name].append(best[name][row, place])
        got = {name: np.concatenate(x) if x else np.zeros(0, bool if name == "_m" else np.int64) for name, x in out.items()}
        ref = got.pop("ref")
        own = edges[ref + 1] - edges[ref] if len(ref) else np.zeros(0, np.int64)
        flat = np.repeat(edges[ref] - (np.cumsum(own) - own), own) + np.arange(own.sum()) if len(ref) else np.zeros(0, np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32))
        return pa.table(got | {"ids": pa.ListArray.from_arrays(ends, pa.array(ids[flat])), "times": pa.ListArray.from_arrays(ends, pa.array(times[flat]))})

    schema = "_a long, _b long, _m boolean, _x long, score long, id long, ids array<long>, times array<long>"
    met = q_side.groupBy("qg", "xg").cogroup(x_side.groupBy("qg", "xg")).applyInArrow(meet, schema)
    key = ["_a", "_b", "_m", "_x"]
    leading = met.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "id"))).where(F.col("_r") <= most)
    tops = leading.groupBy(*key).agg(F.collect_list(F.struct("score", "ids", "times")).alias("_tops")).join(by_node, key)  # at most k + 1
    found = join_counted(asked, materialize(tops, "query-tops"), key, most=512)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from queries with the ids and scores of their best nodes."""
    pairs = F.flatten(F.transform("_tops", lambda t: F.transform(F.arrays_zip(t["ids"], t["times"]), lambda e: F.struct((-t["score"]).alias("s"), e["ids"].alias("i"), e["times"].alias("n")))))
    best: Column = F.slice(F.array_sort(F.filter(pairs, lambda e: e["i"] != F.col("vec_id"))), 1, k)
    rows = found.select(F.col("vec_id").alias("query_id"), F.explode(best).alias("e")).select("query_id", F.col("e.i").alias("vec_id"), (-F.col("e.s")).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("e.n"), F.lit(k)))).alias("_copy"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
