"""Shared pieces: the cluster's shared folder, written tables, vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by vectorised code; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset in local mode.

    On a cluster an unset folder is an error: a local one would be another on every machine.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="pvlens-shared-")
        found = _local[context.applicationId]
    return found.rstrip("/")


_local: dict[str, str] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again.

    Every executor can re-read the written table, so losing one costs no recomputation
    beyond its own tasks. Shuffle files of the finished job become free to clean.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of `materialize` that no later plan reads."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, keyed: DataFrame, on: Sequence[str], n: str = "_n", most: int = 4096) -> DataFrame:
    """Inner join of rows with keyed, a written table of one row a key whose column `n` counts the rows of the key.

    Keys that hold more than a `most`-th of all rows number fewer than `most`, so they are
    broadcast and their rows stay where they are; the other keys are shuffled. `n` is left out.
    """
    on = list(on)
    bound = (keyed.agg(F.sum(n)).first()[0] or 0) / most
    hot = keyed.where(F.col(n) > bound).drop(n)
    near = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keyed.where(F.col(n) <= bound).drop(n), on)
    return near.unionByName(rest)


def join_dealt(rows: DataFrame, wide: DataFrame, on: Sequence[str], most: int = 4096) -> DataFrame:
    """Inner join of rows, a written table, with wide, which has one row of any width a key.

    Keys that hold more than a `most`-th of all rows number fewer than `most`; only they and their counts are
    broadcast. Their rows are dealt over copies of the wide row, of which there are fewer than 2 * most in
    all, so that no key and copy holds more than about a `most`-th of the rows.
    """
    on = list(on)
    bound = max(1, rows.count() // most)
    hot = materialize(rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > bound), "join-hot")
    copies = F.broadcast(hot.select(*on, F.ceil(F.col("_n") / F.lit(bound)).cast("int").alias("_copies")))
    n = F.coalesce(F.col("_copies"), F.lit(1))
    others = [c for c in rows.columns if c not in on]
    dealt = rows.join(copies, on, "left").withColumn("_copy", F.pmod(F.xxhash64(*others), n).cast("int")).drop("_copies")
    copied = wide.join(copies, on, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), n - 1))).drop("_copies")
    return dealt.join(copied, [*on, "_copy"]).drop("_copy")


def identity(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """_d, _t, _text: what makes two rows the same document, and its text; a null text counts as empty.

    _t hashes the text and whether the id is null, so a null id, which takes the smallest long
    in _d, is another document than that long itself.
    """
    body, key = F.coalesce(F.col(text), F.lit("")), F.col(doc_id).cast("long")
    return [F.coalesce(key, F.lit(-(2**63)).cast("long")).alias("_d"), F.xxhash64(body, key.isNull()).alias("_t"), body.alias("_text")]


def identified(docs: DataFrame) -> DataFrame:
    """_d, _t, _text of `identity` and _id, the id itself.

    Rows that repeat id and text are one document for the operators; extra columns are left
    out, so their names cannot clash.
    """
    return docs.select(*identity(), F.col("doc_id").cast("long").alias("_id"))


def smallest_hashes(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows of smallest `order` (a hash) and more: a hash bound that about 4 n rows pass comes first.

    So a sample that goes to the driver does not grow with the number of partitions. Where the
    bound lets fewer than n of them pass by chance, those are the sample.
    """
    share = min(1.0, 4.0 * n / max(1, rows.count()))
    unit = F.shiftrightunsigned(order, 11).cast("double") * F.lit(2.0**-53)
    return rows.where(unit <= F.lit(share))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `size` bytes each, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a public fixed function) over uint64 arrays."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def keys(n: int, seed: int = 0) -> np.ndarray:
    """n pseudo-random odd 64-bit multipliers, the same everywhere."""
    return mix((np.arange(n, dtype=U64) + U64(seed + 1)) * _GOLDEN) | U64(1)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of consecutive texts.

    Returns (hash, start byte, end byte, bounds): bounds[i]:bounds[i+1] are text i's words.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = raw[lo:hi]
    n_docs = len(offsets) - 1
    if hi == lo:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U64), empty, empty, np.zeros(n_docs + 1, np.int64)
    inner = offsets - lo
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = inner[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < hi - lo)]
    first[cuts] = word[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U64), empty, empty, np.zeros(n_docs + 1, np.int64)
    bytes_at = np.flatnonzero(word)
    heads = np.searchsorted(bytes_at, starts)
    lens = np.diff(np.append(heads, len(bytes_at)))
    within = np.arange(len(bytes_at)) - np.repeat(heads, lens)
    terms = (data[bytes_at].astype(U64) + U64(1)) * keys(int(lens.max()))[within]
    h = mix(np.add.reduceat(terms, heads) + lens.astype(U64) * _GOLDEN)
    bounds = np.searchsorted(starts, inner)
    return h, starts + lo, starts + lens + lo, bounds


def gram_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every k consecutive word hashes, ignoring text bounds; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j, m in enumerate(keys(k, seed * 1000)):
        out += h[j : j + n] * m
    return mix(out)
