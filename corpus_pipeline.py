"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing, SentencePiece.

Every stage reads what the one before wrote and hands on the columns of `documents`; the last
returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvlens.llm.common import materialize, table
from pvlens.llm.line_dedup import dedup_lines
from pvlens.llm.mixing import curriculum, schedule
from pvlens.llm.near_dedup import near_duplicate_classes, text_key
from pvlens.llm.pieces import encode_documents
from pvlens.llm.toxicity import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Between a word and the blanks after it; words are `[^\x20\x09-\x0D]+`.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null, empty and blank texts score as texts without words and stay; repeated rows stay or go
    together; rows without an id are scored like others; without labels nothing goes; an empty
    table stays empty. Columns other than those of documents are left out, here and in all stages.
    """
    scored = score_documents(docs.select(COLUMNS), table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go, and documents of which nothing is left.

    A document that loses nothing keeps its row as it is, but for a null text, which becomes
    empty. Rows that repeat id and text lose the same lines. An empty table stays empty.
    """
    found = dedup_lines(docs.select(COLUMNS), keep=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    left = found.where(~changed | (F.length(F.trim("kept_text")) > 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id.

    One row stays of rows that repeat id and text; of an id with two texts each text is judged
    alone; rows without an id stay only where no row of their group has one. Texts without words
    are copies of equal texts only. An empty table stays empty.
    """
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("_key"), F.col("doc_id").isNull().alias("_none")]
    names = ["_key", "_none", "_node"]
    classes = near_duplicate_classes(docs.select(COLUMNS), with_key=True)
    kept = classes.where("kept").select(*key, F.col("text_key").alias("_node")).distinct()
    # Repeated rows are combined before the shuffle, and the join reuses its partitions.
    once = docs.select(*COLUMNS, *key, text_key(F.coalesce("text", F.lit(""))).alias("_node")).dropDuplicates(names)
    return once.join(kept, names, "left_semi").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mix, in training order.

    The words handed on are those that the mix takes: the document across a source's target (one
    a source and pass) is cut after its last word taken, all others are whole. Documents without
    words take no part in a mix of words; repeated rows count each; an empty table stays empty.
    """
    uses = schedule(curriculum(docs.select(COLUMNS), keep=("text", "lang", "n_chars")))
    whole = F.col("words") == F.col("size")
    cut = F.array_join(F.slice(F.split("text", WORD_END), F.lit(1), F.col("words").cast("int")), "")
    uses = uses.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    return uses.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, checked by decoding; empty texts have none."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Classifier, alignment, signatures and Viterbi have no SQL form; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
