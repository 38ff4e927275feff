"""Token counts by the whole-token shortcut.

A byte-level BPE cuts a text into pre-tokens and merges each by itself. Which strings of the
vocabulary come out as one token when they are merged alone is proved once, offline, by merging
each of them. A pre-token that is such a string counts 1 without merging; only the rest goes
through the merges. Proof and tokenizer are broadcast; their size is that of the vocabulary.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .token_files import vocabulary

#: Characters that are cut from one another in any text: a word's end before a blank, a letter before a sign or digit.
CUT = re.compile(r"[^\s](?=[ \t-\r])|[A-Za-z](?=[!-/:-@\[-`{-~0-9])")
#: The pattern of byte-level BPE over printable ASCII without double blanks, where Python's engine and the library's agree.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+| ")
WINDOW = 1 << 20
#: The byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
LETTERS = dict(zip([*PRINTED, *sorted(set(range(256)) - set(PRINTED))], map(chr, [*PRINTED, *range(256, 512)])))
BLANK = LETTERS[32]
#: Below it, letters are letters in every version of Unicode.
LATIN = "\u0250"
#: Counts travel as tokens + (directly counted pre-tokens << 40); a piece whose cut is unsure makes a sum negative.
DIRECT = 40
ONE = (1 << DIRECT) + 1
UNSURE = -(1 << 200)


def prove(path: str) -> tuple[str, frozenset[str], list[str]]:
    """The tokenizer, the strings proved to be one token when merged alone, and the added tokens, of a tokenizers file.

    The strings are written in the byte alphabet, as pre-tokens are. A file that this operator would
    not count rightly is refused.
    """
    text = open(path, encoding="utf-8").read()
    spec = json.loads(text)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE files without normaliser, prefix and suffix can be counted")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take blanks or words along cannot be counted")
    merge = Tokenizer.from_str(text).model.tokenize
    alphabet = set(ByteLevel.alphabet())
    whole = frozenset(t for t in model["vocab"] if t and alphabet.issuperset(t) and len(merge(t)) == 1)
    return text, whole, sorted((t["content"] for t in spec["added_tokens"] if t["content"]), key=len, reverse=True)


class _Memory(dict):
    """Counts of " " + piece; pieces over 64 characters are not kept."""

    def __init__(self, counter: TokenCounter):
        self.chunk, self.whole, self.merge = counter.chunk, counter.whole, counter.merge
        self.marks = frozenset(".,;:!?)").intersection(self.whole)

    def __missing__(self, piece: str) -> int:
        if piece.isalpha() and max(piece) < LATIN:
            token = BLANK + (piece if piece.isascii() else "".join(map(LETTERS.__getitem__, piece.encode())))
            found = ONE if token in self.whole else len(self.merge(token))
        elif piece[-1:] in self.marks and (word := piece[:-1]).isalpha() and max(word) < LATIN:
            return self[word] + ONE
        else:
            found = UNSURE if not piece or piece[0].isspace() else self.chunk(" " + piece)
        if len(piece) <= 64:
            self[piece] = found
        return found


class TokenCounter:
    """Counts of whole texts; one a worker.

    A pre-token never holds anything else before a blank that a character other than white space follows,
    so pieces between such blanks are counted by themselves and remembered (at most `limit`, and what one
    text adds).
    """

    def __init__(self, tokenizer: str, whole: frozenset[str], added: Sequence[str], limit: int = 600_000):
        self.merge, self.whole, self.limit = Tokenizer.from_str(tokenizer).model.tokenize, whole, limit
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.added = re.compile("|".join(re.escape(x) for x in added)) if added else None
        self.memory = _Memory(self)

    def chunk(self, text: str) -> int:
        """Of a text that begins where a pre-token begins; long ones in windows that end where one ends."""
        total, a = 0, 0
        while a < len(text):
            found = CUT.search(text, a + (WINDOW >> 4)) if len(text) - a > WINDOW >> 4 else None
            b = found.end() if found else len(text)
            part, a = text[a:b], b
            if part.isascii() and part.isprintable() and "  " not in part:
                tokens = [BLANK + x[1:] if x[0] == " " else x for x in ASCII.findall(part)]
            else:
                tokens = [x for x, _ in self.cut(part)]
            for token in tokens:
                total += ONE if token in self.whole else len(self.merge(token))
        return total

    def window(self, text: str) -> int:
        pieces = text.split(" ")
        total = sum(map(self.memory.__getitem__, pieces[1:]))
        if total >= 0:
            return total + self.chunk(pieces[0])
        total, held = 0, [pieces[0]]
        for piece in pieces[1:]:
            if piece and not piece[0].isspace():
                total += self._joined(held)
                held = ["", piece]
            else:
                held.append(piece)
        return total + self._joined(held)

    def _joined(self, held: list[str]) -> int:
        return self.memory[held[1]] if len(held) == 2 and not held[0] and held[1] and not held[1][0].isspace() else self.chunk(" ".join(held))

    def segment(self, text: str) -> int:
        total, a = 0, 0
        while a < len(text):
            b = text.find(" ", a + WINDOW) if len(text) - a > WINDOW else -1
            while b >= 0 and (b + 1 == len(text) or text[b + 1].isspace()):
                b = text.find(" ", b + 1)
            b = len(text) if b < 0 else b
            total += self.window(text[a:b])
            a = b
        return total

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens counted directly); an added token inside the text is one token, as the library has it."""
        if len(self.memory) > self.limit:
            self.memory.clear()
        parts = self.added.split(text) if self.added else [text]
        total = sum(map(self.segment, parts))
        return (total & ((1 << DIRECT) - 1)) + len(parts) - 1, total >> DIRECT


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_direct (pre-tokens counted without merging), over_limit, kept columns; a row for each row of docs.

    A null or empty text has no token; repeated rows and rows without an id are counted each; an empty
    table gives no rows. Whole texts are counted, in windows of a million characters cut where pre-tokens
    end; a single pre-token over a window (a word of that length) is held by itself. Other columns are
    left out, so their names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prove(vocabulary(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*shared.value)
        for batch in batches:
            text = batch.column("_text").fill_null("")
            found = [counter.count(x.as_py()) for x in text]
            tokens = np.fromiter((x[0] for x in found), np.int64, len(found))
            columns = {
                "doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_tokens": pa.array(tokens),
                "n_direct": pa.array([x[1] for x in found], pa.int64()), "over_limit": pa.array(tokens > limit),
            }
            yield pa.RecordBatch.from_pydict(columns | {f"_keep_{i}": batch.column(f"_keep_{i}") for i in range(len(keep))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)))
    kept = "".join(f", _keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_direct long, over_limit boolean" + kept)
    return counted.select("doc_id", "n_bytes", "n_tokens", "n_direct", "over_limit", *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)))
