"""Token ids in binary files: one shared zstandard dictionary, one frame a document.

A file is a row of segments, each followed by one byte 0x0A (the row separator of Spark's
text writer, through which the bytes reach any file system that Spark can write):

    magic "PVTI0001", total length u64, part u32, seq u32, documents u32, id width u8,
    start of the first document in its part u64, SHA-256 of the dictionary 32 bytes,
    frames (a zstd frame a document, over its ids as little-endian integers),
    index (doc_id i64, null u8, offset u64, length u32, ids u32 for each document).

A document is reached by its index entry alone, without reading its neighbours. A file holds at
most `file_segments` segments, so that a reader's memory does not grow with the table.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import smallest_hashes

MAGIC = b"PVTI0001"
HEAD = struct.Struct("<8sQIIIBQ32s")
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u4")])
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return path


class Encoder:
    """tokenizers' encoding of whole texts, with a bounded memory of the pieces between blanks.

    The pattern of byte-level BPE always cuts before a blank that stands between two other
    characters that are not white space, so the pieces encode alone as in the text. Texts with
    other blanks are cut only at such blanks.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker a core
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.limit = limit
        vocab = self.tokenizer.get_vocab()
        #: Ids whose token begins with a blank, which the byte alphabet writes as U+0120.
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.starts[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.inner: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, wanted: set[str]) -> None:
        fresh = []
        for x in wanted:
            if x in self.older:
                self.inner[x] = self.older[x]
            elif not x or x[0].isspace() or x[-1].isspace():
                self.inner[x] = None
            else:
                fresh.append(x)
        groups = [fresh[a : a + 64] for a in range(0, len(fresh), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.code)
            cuts = np.flatnonzero(self.starts[ids]) * self.width
            if len(cuts) == len(group):  # each piece begins with its blank and holds no other
                packed, cuts = ids.tobytes(), cuts.tolist()
                for x, a, b in zip(group, cuts, [*cuts[1:], len(packed)]):
                    self.inner[x] = packed[a:b]
            else:
                for x, own in zip(group, self._whole([" " + x for x in group])):
                    self.inner[x] = own

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        pieces = [t.split(" ") for t in texts]
        wanted = set().union(*(p[1:] for p in pieces))
        # What this call needs must be in the young generation at once.
        missing = wanted.difference(self.inner)
        if len(self.inner) + len(missing) > self.limit:
            self.older, self.inner = self.inner, {}
            missing = wanted
        self._learn(missing)
        heads = self._whole([p[0] for p in pieces])
        get = self.inner.__getitem__
        out: list[bytes | None] = []
        for p, head in zip(pieces, heads):
            try:
                if len(p) > 1 and (not p[0] or p[0][-1].isspace()):
                    raise TypeError
                out.append(head + b"".join(map(get, p[1:])))
            except TypeError:
                out.append(None)
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = self._careful(texts[i])
        return out

    def _careful(self, text: str) -> bytes:
        parts = SAFE_SPACE.split(text)
        found = self.tokenizer.encode_batch_fast([parts[0], *(" " + x for x in parts[1:])], add_special_tokens=False)
        return b"".join(self.pack(e.ids) for e in found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = 1000, max_chars: int = 20_000, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary over the packed ids of a bounded sample.

    The sample is the `sample_docs` documents of at most `max_chars` characters with the
    smallest hashes: long documents do not need a dictionary. Empty where nothing can be learned.
    """
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit("dictionary"))
    rows = smallest_hashes(docs.where(F.length("text").between(1, max_chars)), order, sample_docs)
    rows = rows.select("text", order.alias("_o")).orderBy("_o", "text").limit(sample_docs)
    samples = encoder(path).encode([r.text for r in rows.collect()])
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=3, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]  # too few samples: their bytes are the dictionary


def _compression(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def segment(part: int, seq: int, start: int, width: int, digest: bytes, rows: list[tuple[int | None, bytes, int]]) -> bytes:
    """rows: doc_id, frame, number of ids."""
    index = np.zeros(len(rows), ENTRY)
    at = HEAD.size
    for i, (doc_id, frame, n) in enumerate(rows):
        index[i] = (doc_id or 0, doc_id is None, at, len(frame), n)
        at += len(frame)
    body = b"".join(f for _, f, _ in rows) + index.tobytes()
    return HEAD.pack(MAGIC, HEAD.size + len(body), part, seq, len(rows), width, start, digest) + body


def segments(content: bytes) -> Iterator[tuple[dict, np.ndarray, memoryview]]:
    """Header, index and bytes of each segment of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, total, part, seq, n, width, start, digest = HEAD.unpack_from(view, at)
        if magic != MAGIC or view[at + total] != 10:
            raise ValueError("not a token-id segment")
        own = view[at : at + total]
        yield {"part": part, "seq": seq, "width": width, "start": start, "digest": digest}, np.frombuffer(own[total - n * ENTRY.itemsize :], ENTRY), own
        at += total + 1


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = 2, segment_bytes: int = 4 << 20, level: int = 3, file_segments: int = 16) -> None:
    """Write `folder`/dictionary and `folder`/ids, documents in ascending doc_id order, nulls first.

    A null text is empty; a repeated doc_id is written as often as it comes, ordered by its
    text's hash. Parts hold what their range of (id, hash, place in the scan) holds, so rows of
    one id spread over parts too; a segment ends at `segment_bytes`, a file after `file_segments`.
    """
    path = vocabulary(tokenizer)
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest()
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(dictionary),)], "b binary").coalesce(1).select(F.col("b").cast("string")).write.text(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        tail = own.pack([] if end_id is None else [end_id])
        pack = zstandard.ZstdCompressor(level=level, dict_data=_compression(dictionary))
        part, seq, start, first, held, rows = TaskContext.get().partitionId(), 0, 0, 0, 0, []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([segment(part, seq, first, own.width, digest, rows)], pa.binary())], ["b"])
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(ids), 256):
                for doc_id, packed in zip(ids[a : a + 256], own.encode([t or "" for t in texts[a : a + 256]])):
                    packed += tail
                    frame, n = pack.compress(packed), len(packed) // own.width
                    rows.append((doc_id, frame, n))
                    start, held = start + n, held + len(frame)
                    if held >= segment_bytes:
                        yield emit()
                        seq, first, held, rows = seq + 1, start, 0, []
        if rows:
            yield emit()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_at"))
    order = ["doc_id", "_h", "_at"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, "b binary").select(F.col("b").cast("string")).write.option("maxRecordsPerFile", file_segments).text(f"{folder}/ids")


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    files = spark.read.format("binaryFile").load(f"{folder}/dictionary").select("content").collect()
    return bytes(files[0].content)[:-1]


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files alone."""
    dictionary = read_dictionary(spark, folder)
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_compression(dictionary))
        for batch in batches:
            for content in batch.column("content"):
                for head, index, own in segments(content.as_buffer()):
                    if head["digest"] != digest:
                        raise ValueError("the segment belongs to another dictionary")
                    crcs, lists = [], []
                    for e in index:
                        packed = unpack.decompress(own[int(e["offset"]) : int(e["offset"]) + int(e["length"])])
                        wide = np.frombuffer(packed, f"<u{head['width']}").astype("<u4")
                        crcs.append(zlib.crc32(wide.tobytes()))
                        lists.append(wide.astype(np.int64) if with_ids else None)
                    counts = index["ids"].astype(np.int64)
                    cols = {
                        "doc_id": pa.array(index["doc_id"].astype(np.int64), mask=index["null"].astype(bool)),
                        "_part": pa.array(np.full(len(index), head["part"], np.int64)),
                        "_inner": pa.array(head["start"] + np.cumsum(counts) - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array(lists, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, _part long, _inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = spark.read.format("binaryFile").load(f"{folder}/ids").select("content").mapInArrow(run, schema)
    heads = spark.read.format("binaryFile").load(f"{folder}/ids").select("content").mapInArrow(_totals, "_part long, _n long")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = heads.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    kept = ["n_tokens", "ids_crc32", *["ids"] * with_ids]
    return rows.join(shift, "_part").select("doc_id", (F.col("_shift") + F.col("_inner")).alias("start"), *kept)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Part and number of ids of each segment, from the indexes alone."""
    for batch in batches:
        for content in batch.column("content"):
            found = [(head["part"], int(index["ids"].sum())) for head, index, _ in segments(content.as_buffer())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["_part", "_n"])
