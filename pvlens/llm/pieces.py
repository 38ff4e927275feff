"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores come from a public model file, read here without the library. In a
file of a unigram model the scores are log probabilities; in one of a BPE model they are
minus the merge ranks, from which -log(2 + rank) makes log scores by Zipf's law.
Blanks become the marker U+2581 and one marker goes in front; characters that no piece covers
fall back to byte pieces. No piece holds a marker after another character, so the best path
never crosses from one word into the next marker: words are solved alone and remembered.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Fixed value: how far below the worst piece an uncovered character scores.
UNKNOWN_PENALTY = 10.0


def _fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool, bool]:
    """(piece, log score, type) of every id; whether a marker goes in front; whether extra blanks go.

    A model that maps characters before encoding (NFKC and the like) is refused.
    """
    pieces, prefix, squeeze, ranked = [], True, True, False
    with open(path, "rb") as f:
        data = memoryview(f.read())
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            pieces.append((bytes(own.get(1, b"")).decode("utf-8"), float(own.get(2, 0.0)), int(own.get(3, NORMAL))))
        elif field == 2:
            ranked = dict(_fields(value)).get(3, 1) == 2  # the type of the model: BPE
        elif field == 3:
            rules = dict(_fields(value))
            prefix, squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
            if len(rules.get(2, b"")):
                raise ValueError("the model normalises characters, which is not built here")
    if ranked:
        pieces = [(p, -math.log(2 - s), t) for p, s, t in pieces]
    return pieces, prefix, squeeze


def double_array(words: list[tuple[bytes, int]]) -> tuple[array, array, array]:
    """base, check and value arrays: the child of node s by byte c is base[s] + c + 1 if check there is s."""
    tree: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for word, value in words:
        node = 0
        for c in word:
            if c not in tree[node]:
                tree[node][c] = len(tree)
                tree.append({})
                ends.append(-1)
            node = tree[node][c]
        ends[node] = value
    size = 2 * len(tree) + 600
    base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
    check[0] = 0
    begin, todo = 1, [(0, 0)]
    while todo:
        node, at = todo.pop()
        value[at] = ends[node]
        own = sorted(tree[node])
        if not own:
            continue
        first, slot, full = own[0] + 1, max(begin, own[0] + 1), 0
        while True:
            if slot + 300 >= len(check):
                base.extend([0] * 4096)
                value.extend([-1] * 4096)
                check.extend([-1] * 4096)
            if check[slot] != -1:
                full += 1
            elif all(check[slot - first + c + 1] == -1 for c in own):
                break
            slot += 1
        if full >= 0.9 * (slot - begin + 1):  # the slots up to here are nearly all taken
            begin = slot
        base[at] = slot - first
        for c in own:
            check[slot - first + c + 1] = at
            todo.append((tree[node][c], slot - first + c + 1))
    return base, check, value


@dataclass
class Model:
    """Everything a worker needs; small (about 2 MB for 32,000 pieces) and sent by closure."""

    base: array
    check: array
    value: array
    scores: array
    bytes_at: list[int]
    pieces: list[bytes]
    types: bytes
    prefix: bool
    squeeze: bool = False
    limit: int = 500_000

    @classmethod
    def load(cls, path: str) -> Model:
        rows, prefix, squeeze = read_model(path)
        usable = [(p.encode(), i) for i, (p, _, t) in enumerate(rows) if t in (NORMAL, USER) and p]
        if any(MARK in p.lstrip(MARK) for p, _, t in rows if t in (NORMAL, USER)):
            raise ValueError("a piece holds a marker after another character; words cannot be solved alone")
        base, check, value = double_array(usable)
        bytes_at = [-1] * 256
        for i, (p, _, t) in enumerate(rows):
            if t == BYTE:
                bytes_at[int(p[1:-1], 16)] = i
        if -1 in bytes_at:
            raise ValueError("the model has no byte pieces")
        top = max((s for _, s, t in rows if t == NORMAL), default=0.0)
        scores = array("d", [len(p) * top - 0.1 if t == USER else s for p, s, t in rows])
        spoken = [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t in (NORMAL, USER) else b"" for p, _, t in rows]
        return cls(base, check, value, scores, bytes_at, spoken, bytes(t for _, _, t in rows), prefix, squeeze)

    @property
    def lowest(self) -> float:
        return min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0) - UNKNOWN_PENALTY

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of equal paths the one whose last piece starts first."""
        data = text.encode()
        n, base, check, value, scores = len(data), self.base, self.check, self.value, self.scores
        unknown = self._unknown
        best = [float("-inf")] * (n + 1)
        back, made = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = data[i]
            step = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            here, node, j, covered = best[i], 0, i, False
            while j < n:
                at = base[node] + data[j] + 1
                if check[at] != node:
                    break
                node, j = at, j + 1
                if (v := value[node]) >= 0:
                    if (s := here + scores[v]) > best[j]:
                        best[j], back[j], made[j] = s, i, v
                    covered |= j == i + step
            if not covered and (s := here + unknown) > best[i + step]:
                best[i + step], back[i + step], made[i + step] = s, i, -1
            i += step
        out, j = [], n
        while j > 0:
            i = back[j]
            if made[j] >= 0:
                out.append(made[j])
            else:
                out.extend(self.bytes_at[b] for b in reversed(data[i:j]))
            j = i
        return out[::-1]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @property
    def _unknown(self) -> float:
        if "_low" not in self.__dict__:
            self.__dict__["_low"] = self.lowest
        return self.__dict__["_low"]

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers. Words are remembered in this form, a third of a list's size."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        memory = self.__dict__.setdefault("_memory", {})
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        out: list[bytes] = []
        for word in WORDS.findall(marked):
            found = memory.get(word)
            if found is None:
                found = array("I", self.viterbi(word)).tobytes()
                if len(word) <= 64:
                    if len(memory) >= self.limit:
                        memory.clear()
                    memory[word] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.pieces.__getitem__, ids))
        text = data.decode("utf-8", errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, Model] = {}


def model(path: str | None) -> Model:
    """One a process; it outlives a task, so its memory of words does too."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32, decoded_sha256, round_trip (and kept columns) of every row.

    ids_crc32 is over the ids as little-endian 32-bit integers; decoded_sha256 is of the text
    that the ids decode to; round_trip says whether that is the text itself (a text holding the
    marker U+2581 decodes to blanks, and a model may drop extra blanks). Null and empty texts have no ids. Repeated rows are
    encoded as often as they come; other columns are ignored.
    """
    import hashlib

    fields = {f.name: f for f in docs.schema.fields}
    source = docs.select("doc_id", "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole.slice(a, 512)
                ids, counts, crcs, shas, same = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    packed = own.packed(text)
                    spoken = own.decode(array("I", packed))
                    ids.append(packed)
                    counts.append(len(packed) // 4)
                    crcs.append(zlib.crc32(packed))
                    shas.append(hashlib.sha256(spoken.encode()).hexdigest())
                    same.append(spoken == text)
                cols = {c: batch.column(c) for c in ("doc_id", *keep)}
                cols |= {"n_pieces": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "decoded_sha256": pa.array(shas), "round_trip": pa.array(same)}
                if with_ids:
                    flat = pa.array(memoryview(b"".join(ids)).cast("i") if any(ids) else [], pa.int32())
                    ends = [0]
                    for n in counts:
                        ends.append(ends[-1] + n)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_pydict(cols)

    names = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    schema = names + ", n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema)
