"""Filter interaction audit: what every order of a set of filters keeps, removes and loses.

Each document has a mask, a bit for every filter it fails. Counts by part and mask (2^k a part) are
all that the audit needs: the subset-zeta transform turns them into survivors of every set of
filters (documents whose mask has no bit of the set), and a step of an order is the difference
between the survivors of two sets that differ in one filter. Labels are carried as further counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: The letter of each filter; bit i of a mask is the i-th.
LETTERS = "ABCDE"


def text_failures(text: Column, words: Column, least_words: int = 100, distinct_percent: int = 80, capitals_percent: int = 10, marks: str = "[#$%&*|]") -> list[Column]:
    """Too few words, too few distinct ones, too many capitals, a mark: what a text fails by itself."""
    n = F.size(words).cast("long")
    return [
        n < least_words,
        100 * F.size(F.array_distinct(words)).cast("long") < distinct_percent * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > capitals_percent * F.length(text).cast("long"),
        text.rlike(marks),
    ]


def bits(failures: Sequence[Column]) -> Column:
    """The mask: bit i for failure i."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """part, mask, n, good, toxic: documents of each lang (null: empty string) by the filters they fail.

    E, a copy, is a text that a row of a smaller id has, in any part; of rows that repeat id and
    text none is a copy of another, and rows without an id come after all others, none before
    another. good and toxic count documents that a row of labels says are; of several rows for an
    id any one counts. A null text is empty.

    Texts are hashed (SHA-256) and judged where they are read; rows of (id, hash, part, mask)
    are counted before the shuffle, then rows without an id are spread by their hash. Of a text
    with many copies a few rows, one a part, label and mask, meet to find the smallest id.
    """
    body = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), body.alias("_text")).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    judged = read.select("_id", "part", F.unhex(F.sha2(F.encode("_text", "UTF-8"), 256)).alias("_key"), bits(text_failures(F.col("_text"), F.col("_words"), **limits)).alias("_own"))
    rows = judged.groupBy("_id", "_key", "part", "_own").agg(F.count("*").alias("_n"))
    # A null id gets the hash of its text as its key, beside a flag that no label has.
    spread = rows.withColumn("_none", F.col("_id").isNull()).withColumn("_at", F.coalesce("_id", F.xxhash64("_key")))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_at")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    known = spread.join(said.withColumn("_none", F.lit(False)), ["_at", "_none"], "left").select("*", *(F.coalesce(c, F.lit(False)).alias(c[1:]) for c in ("_good", "_toxic")))
    # The smallest id of each kind of row, with how many rows have it: only they may be no copies.
    kinds = known.groupBy("_key", "part", "_own", "good", "toxic").agg(F.sum("_n").alias("_n"), F.min(F.struct("_none", "_id")).alias("_first"), F.min(F.struct("_none", "_id", "_n")).alias("_least"))
    w = Window.partitionBy("_key")
    first = kinds.withColumn("_lowest", F.min("_first").over(w)).withColumn("_nameless", F.col("_lowest._none"))
    kept = F.when(F.col("_nameless"), F.col("_n")).when(F.col("_first") == F.col("_lowest"), F.col("_least._n")).otherwise(F.lit(0))
    split = first.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("_own").alias("mask"), kept.alias("n")), F.struct((F.col("_own") + (1 << 4)).alias("mask"), (F.col("_n") - kept).alias("n")))))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def zeta_pass(held: Column, i: int, k: int) -> Column:
    """Adds to each mask's sum the one of the mask without bit i; after all k passes, of every mask, the sum over its submasks."""
    bit = F.lit(1 << i)
    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: F.get(held, m) + F.when(m.bitwiseAND(bit) != 0, F.get(held, m.bitwiseXOR(bit))).otherwise(F.lit(0).cast("long")))


def survivors(counts: DataFrame, k: int = 5, values: Sequence[str] = ("n", "good", "toxic")) -> DataFrame:
    """part and, for each value, an array over sets of filters: what is left after all filters of the set.

    counts: part, mask, values. The 2^k counts of a part come together in one row; then every pass of the
    transform is an expression of its own row.
    """
    gathered = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*values)))).alias("_by"))  # at most 2^k masks a part
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    rows = gathered.select("part", *(F.transform(every, lambda m: F.coalesce(F.try_element_at("_by", m)[v].cast("long"), F.lit(0).cast("long"))).alias(v) for v in values))
    for i in range(k):
        rows = rows.select("part", *(zeta_pass(F.col(v), i, k).alias(v) for v in values))
    full = (1 << k) - 1
    return rows.select("part", *(F.transform(every, lambda m: F.get(F.col(v), F.lit(full) - m)).alias(v) for v in values))  # noqa: B023


def audit(left: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and what the step does, for every order; left as from `survivors`, a row a part.

    kept after the step and removed in it; redundant: failing its filter but removed before;
    unique_fails: failing its filter only; good_lost and toxic_lost: labelled among the removed;
    shapley: removed by the filter, summed over all orders (its place in an order only depends on the
    set before it, so the sum is over sets, each times the orders that begin with it).
    """
    k = len(letters)
    full = (1 << k) - 1
    at = lambda name, mask: F.get(F.col(name), mask)
    shares = []
    for i in range(k):
        sets = [s for s in range(full + 1) if not s >> i & 1]
        weight = lambda s: factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())
        shares.append(sum(((at("n", F.lit(s)) - at("n", F.lit(s | 1 << i))) * weight(s) for s in sets), F.lit(0).cast("long")))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    steps = left.select("part", "n", "good", "toxic", F.array(*shares).alias("_shares"), F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = F.instr(F.lit(letters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    mask = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(letters)), F.lit(0))
    cut = steps.withColumn("_i", place).withColumn("_bit", F.expr("shiftleft(1, _i)")).withColumn("_before", mask).withColumn("_after", F.col("_before") + F.col("_bit"))
    lost = lambda name: at(name, F.col("_before")) - at(name, F.col("_after"))
    fails = at("n", F.lit(0)) - at("n", F.col("_bit"))
    return cut.select(
        "part", "filter_order", "step", at("n", F.col("_after")).alias("kept"), lost("n").alias("removed"), (fails - lost("n")).alias("redundant"),
        (at("n", F.lit(full) - F.col("_bit")) - at("n", F.lit(full))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("_shares", F.col("_i")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The audit of the five filters over docs, by lang: 120 orders of 5 steps a part, zeros included; no rows for an empty table.

    The counts of `mask_counts`, with what it says of nulls, copies and repeats. Columns other than
    doc_id, text, lang (and doc_id, quality, toxic of labels) are left out, so their names cannot clash.
    """
    return audit(survivors(mask_counts(docs, labels, **limits)))
