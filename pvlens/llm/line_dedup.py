"""Line dedup by pairwise alignment.

Every line that is not blank is hashed. Documents are linked by what they share: a line, or two
adjacent lines of which one is short. A link is rare if at most `rare_docs` documents hold it;
the holders of a rare link are paired, each with every earlier one. Two paired documents are
aligned by patience diff over all their lines: lines that are unique in both give the longest
increasing chain, repeated lines (by occurrence) extend it. Aligned blocks are deleted from the
later document (by doc_id), but not a single short line that many documents hold, unless it is
the whole of both.

A link that many documents hold pairs each of them with its earliest holder first. Where the
alignments leave linked lines, a document meets the other earlier holders of those lines, in
ever larger samples by hash, until the lines go or no holder is left; so the result is that of
aligning it with every earlier document. Only line hashes are shuffled. Pairs grow with the
links, and with the square of a group only where holder after holder has the line in an order
that does not align.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, identity, join_counted, join_dealt, materialize


def _digest(text: str) -> tuple[int, int]:
    raw = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


#: What a link rests on: a long line, a short line, two adjacent lines of which one is short.
LONG, SHORT, PAIR = 0, 1, 2


def numbered(marks: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], Counter]:
    """Each line's hashes with its occurrence among equal lines; how often each line occurs."""
    seen: Counter = Counter()
    out = []
    for mark in marks:
        out.append((*mark, seen[mark]))
        seen[mark] += 1
    return out, seen


def line_units(text: str, min_chars: int) -> tuple[list[int], list[int], int, list[dict]]:
    """Hashes (two a line), hashes of the blank lines after each line (0 if none) and before the first; links.

    Only lines that are not blank count.
    """
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return [], [], 0, []
    marks = [_digest(lines[i]) for i in full]
    tails = [_digest("\n".join(lines[i + 1 : j]))[0] if j > i + 1 else 0 for i, j in zip(full, [*full[1:], len(lines)])]
    head = _digest("\n".join(lines[: full[0]]))[0] if full[0] else 0
    names, _ = numbered(marks)
    short = [len(lines[i].strip()) < min_chars for i in full]
    links = [{"key": _digest(f"{SHORT if s else LONG} {n}")[0], "o": o, "kind": SHORT if s else LONG} for o, (n, s) in enumerate(zip(names, short))]
    links += [{"key": _digest(f"{PAIR} {names[o]} {names[o + 1]}")[0], "o": o, "kind": PAIR} for o in range(len(full) - 1) if short[o] or short[o + 1]]
    if len(full) == 1 and short[0]:  # a copy of a whole document goes, however many hold it
        links.append({"key": _digest(f"only {names[0]}")[0], "o": 0, "kind": LONG})
    return [h for mark in marks for h in mark], tails, head, links


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first member, that increases in the second."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        j = bisect_left(ends, b)
        if j == len(ends):
            ends.append(b)
            at.append(i)
        else:
            ends[j], at[j] = b, i
        back.append(at[j - 1] if j else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(matches: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Aligned (own, other) ordinals from (own, other, unique in both) matches.

    Unique lines first; then, in each gap between them, the repeated lines of the gap.
    """
    chain = longest_chain(sorted((a, b) for a, b, unique in matches if unique))
    rest = sorted((a, b) for a, b, unique in matches if not unique)
    if not rest:
        return chain
    fences = [(-1, -1), *chain, (1 << 60, 1 << 60)]
    out, r = list(chain), 0
    for (a0, b0), (a1, b1) in zip(fences, fences[1:]):
        inside = []
        while r < len(rest) and rest[r][0] < a1:
            if rest[r][0] > a0 and b0 < rest[r][1] < b1:
                inside.append(rest[r])
            r += 1
        out += longest_chain(inside)
    return sorted(out)


def _unit_batches(min_chars: int):
    links = pa.list_(pa.struct([("key", pa.int64()), ("o", pa.int32()), ("kind", pa.int32())]))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch = whole.slice(a, 1024)
                marks, tails, heads, found = [], [], [], []
                for text in batch.column("_text").to_pylist():
                    for column, x in zip((marks, tails, heads, found), line_units(text, min_chars)):
                        column.append(x)
                cols = [batch.column("_d"), batch.column("_t"), pa.array(marks, longs), pa.array(tails, longs), pa.array(heads, pa.int64()), pa.array(found, links)]
                yield pa.RecordBatch.from_arrays(cols, ["_d", "_t", "_marks", "_tails", "_head", "_links"])

    return run, "_d long, _t long, _marks array<long>, _tails array<long>, _head long, _links array<struct<key: long, o: int, kind: int>>"


def align(own: dict, other: dict, firm: set[int], min_block_lines: int) -> list[int]:
    """Codes 8 * line + bits of own's lines that go; lines are counted without blank ones.

    firm: own's lines that may go alone. Bits: 1 the line, 2 the blank lines after it, 4 those
    before the first one.
    """
    a_names, a_times = numbered(list(zip(own["marks"][::2], own["marks"][1::2])))
    b_names, b_times = numbered(list(zip(other["marks"][::2], other["marks"][1::2])))
    at = {x: o for o, x in enumerate(b_names)}
    matches = [(a, at[x], a_times[x[:2]] == 1 and b_times[x[:2]] == 1) for a, x in enumerate(a_names) if x in at]
    blocks: list[list[tuple[int, int]]] = []
    for a, b in patience(matches):
        if blocks and blocks[-1][-1] == (a - 1, b - 1):
            blocks[-1].append((a, b))
        else:
            blocks.append([(a, b)])
    gone = []
    for block in blocks:
        if len(block) < min_block_lines or (len(block) == 1 and block[0][0] not in firm):
            continue
        for a, b in block:
            tail = own["tails"][a] != 0 and ((a, b) != block[-1] or own["tails"][a] == other["tails"][b])
            gone.append(a * 8 + 1 + 2 * tail + 4 * (a == 0 and b == 0 and own["head"] != 0 and own["head"] == other["head"]))
    return gone


def _align_batches(min_block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                out = []
                for r in batch.select(["_marks", "_tails", "_head", "_firm", "_fmarks", "_ftails", "_fhead"]).to_pylist():
                    own = {"marks": r["_marks"], "tails": r["_tails"], "head": r["_head"]}
                    other = {"marks": r["_fmarks"], "tails": r["_ftails"], "head": r["_fhead"]}
                    out.append(align(own, other, set(r["_firm"]), min_block_lines))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_d", "_t", "_fd", "_ft")), pa.array(out, pa.list_(pa.int64()))], ["_d", "_t", "_fd", "_ft", "_gone"])

    return run, "_d long, _t long, _fd long, _ft long, _gone array<long>"


def deleted_lines(docs: DataFrame, min_chars: int = 20, min_block_lines: int = 1, rare_docs: int = 10, salt_rows: int = 4096) -> DataFrame:
    """_d, _t, _gone, partners of the documents that lose lines; _gone as in `align`."""
    run, schema = _unit_batches(min_chars)
    # Rows that repeat id and text are one document.
    units = materialize(identified(docs).select("_d", "_t", "_text").mapInArrow(run, schema).dropDuplicates(["_d", "_t"]), "line-units")
    links = units.select("_d", "_t", F.inline("_links"))
    held = links.groupBy("key").agg(F.min(F.struct("_d", "_t")).alias("_first"), F.count("*").alias("_n"), F.min("kind").alias("_kind"))
    held = materialize(held.where((F.col("_n") > 1) & ((F.col("_kind") != SHORT) | (F.col("_n") <= rare_docs))), "line-keys")
    rare = links.join(held.where(F.col("_n") <= rare_docs).select("key"), "key")
    members = rare.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_d", "_t", "o", "kind"))).alias("_all"))  # at most rare_docs
    paired = members.select("key", "_all", F.posexplode("_all").alias("_i", "_own")).where("_i > 0")
    earlier = F.transform(F.slice("_all", F.lit(1), F.col("_i")), lambda x: F.struct(x["_d"].alias("_d"), x["_t"].alias("_t")))
    paired = paired.select("_own._d", "_own._t", "key", "_own.o", "_own.kind", earlier.alias("_others"), F.lit(1).cast("long").alias("_n"))
    often = join_counted(links, held.where(F.col("_n") > rare_docs).select("key", "_first", "_n", F.col("_n").alias("_held")), ["key"]).where(F.struct("_d", "_t") != F.col("_first"))
    often = often.select("_d", "_t", "key", "o", "kind", F.array("_first").alias("_others"), F.col("_held").alias("_n"))
    by = paired.unionByName(often).groupBy("_d", "_t").agg(F.collect_list(F.struct("key", "o", "kind", "_n")).alias("_met"), F.array_distinct(F.flatten(F.collect_list("_others"))).alias("_with"))
    lines = units.select("_d", "_t", "_marks", "_tails", "_head")
    firm = F.transform(F.filter("_met", lambda x: x["kind"] != PAIR), lambda x: x["o"])
    later = materialize(by.join(lines, ["_d", "_t"]).withColumn("_firm", firm), "line-later")
    own = ["_d", "_t", "_marks", "_tails", "_head", "_firm"]
    other = lines.select(*(F.col(c).alias(f"_f{c[1:]}") for c in lines.columns))
    pair, out = _align_batches(min_block_lines)

    def aligned(pairs: DataFrame) -> DataFrame:
        """pairs: _d, _t, _fd, _ft. One document may be the partner of most others: its lines are copied, the pairs dealt over the copies."""
        pairs = materialize(pairs, "line-pairs")
        both = join_dealt(pairs, other, ["_fd", "_ft"]).join(later.select(*own), ["_d", "_t"])
        return materialize(both.mapInArrow(pair, out).where(F.size("_gone") > 0), "line-aligned")

    def left_of(links: DataFrame, found: DataFrame) -> DataFrame:
        """Links with a line that no alignment has taken so far."""
        gone = found.select("_d", "_t", F.explode("_gone").alias("_o")).select("_d", "_t", F.shiftright("_o", 3).cast("int").alias("_o")).distinct()
        need = links.select("*", F.explode(F.when(F.col("kind") == PAIR, F.array("o", F.col("o") + 1)).otherwise(F.array("o"))).alias("_o"))
        return need.join(gone, ["_d", "_t", "_o"], "left_anti").drop("_o").distinct()

    found = aligned(later.select("_d", "_t", F.explode("_with").alias("_w")).select("_d", "_t", F.col("_w._d").alias("_fd"), F.col("_w._t").alias("_ft")))
    frequent = later.select("_d", "_t", F.inline("_met")).where("_n > 1")
    left = materialize(left_of(frequent, found), "line-left")
    # The holders of a link are met in samples of about 16, 256, ... of them, by hash, while lines are left.
    unit = F.shiftrightunsigned(F.xxhash64("_d", "_t", "key"), 11).cast("double") * F.lit(2.0**-53)
    reach = 16
    while not left.isEmpty():
        open_keys = left.groupBy("key").agg(F.count("*").alias("_open"))
        open_keys = materialize(open_keys.join(held.select("key", F.col("_n").alias("_held")), "key"), "line-open")
        counted = open_keys.withColumn("_share", F.col("_held"))
        sample = join_counted(links, counted, ["key"], "_share").where((unit * F.col("_held") >= reach / 16 - (reach == 16)) & (unit * F.col("_held") < reach))
        # Many open documents of one link spread over salts; each salt has the sample.
        salts = F.ceil(F.col("_open") / F.lit(salt_rows)).cast("int")
        sample = sample.select("key", F.col("_d").alias("_fd"), F.col("_t").alias("_ft"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
        dealt = join_counted(left, open_keys.select("key", "_open", F.col("_open").alias("_share")), ["key"], "_share").withColumn("_salt", F.pmod(F.xxhash64("_d", "_t"), salts).cast("int"))
        pairs = dealt.join(sample, ["key", "_salt"]).where(F.struct("_fd", "_ft") < F.struct("_d", "_t")).select("_d", "_t", "_fd", "_ft").distinct()
        more = aligned(pairs)
        found = found.unionByName(more)
        left = materialize(left_of(left, more).where(F.col("_n") > reach), "line-left")
        reach *= 16
    # A pair met by two links in two rounds counts once.
    once = found.dropDuplicates(["_d", "_t", "_fd", "_ft"])
    return once.groupBy("_d", "_t").agg(F.array_distinct(F.flatten(F.collect_list("_gone"))).alias("_gone"), F.count("*").cast("int").alias("partners"))


def remove_lines(text: str, gone: list[int]) -> tuple[str, int, int]:
    """The kept text, the number of lines, the number of lines removed."""
    lines = text.split("\n")
    if not gone:
        return text, len(lines), 0
    drop = np.zeros(len(lines), bool)
    full = [i for i, x in enumerate(lines) if x.strip()]
    after = [*full[1:], len(lines)]
    for code in gone:
        o, bits = code >> 3, code & 7
        p = full[o]
        drop[p] = True
        if bits & 2:
            drop[p + 1 : after[o]] = True
        if bits & 4:
            drop[:p] = True
    return "\n".join(x for x, d in zip(lines, drop) if not d), len(lines), int(drop.sum())


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_block_lines: int = 1, keep: tuple[str, ...] = (), rare_docs: int = 10) -> DataFrame:
    """doc_id, kept_text, n_lines, n_removed, partners (and kept columns) for every row.

    "Later" is by doc_id, then by text hash; null ids come first, with the smallest long. Lines shorter than `min_chars`
    that more than `rare_docs` documents hold go only beside another line of an aligned block; blank
    lines go with the lines before them. A document that holds one line several
    times keeps it unless an earlier document holds it as often. Rows repeating id and text are
    one document and get the same result. Null and empty texts have one empty line and lose
    nothing; an empty table gives no rows; clashing or extra columns are ignored unless kept.
    """
    gone = deleted_lines(docs, min_chars, min_block_lines, rare_docs)
    extra = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").alias("doc_id"), *identity(), *extra)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, own in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist()):
                kept, n, m = remove_lines(text, own or [])
                texts.append(kept)
                n_lines.append(n)
                n_removed.append(m)
            cols = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), batch.column("partners").fill_null(0)]
            cols += [batch.column(f"_keep_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "kept_text", "n_lines", "n_removed", "partners", *keep])

    schema = f"doc_id {fields['doc_id']}, kept_text string, n_lines long, n_removed long, partners int" + "".join(f", `{c}` {fields[c]}" for c in keep)
    return rows.join(gone, ["_d", "_t"], "left").drop("_d", "_t").mapInArrow(run, schema)
