"""Conservative CSV scan of telemetry: text first, duplicates out, then typed and sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.gates import demand
from ..functions.scalars import blank_to_null, parse_number, parse_timestamp


def read_text_columns(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as text, with _file and _pos: the row's place, files in the order of their paths, rows in file order.

    Rows keep the order of their piece of a file; pieces, of which there is one row each, are
    numbered by path and start. A folder without CSV files is an error.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    raw = reader.csv(path)
    if not raw.columns:
        raise FileNotFoundError(f"no CSV file in {path}")
    own = raw.columns
    rows = raw.select(*own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    pieces = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"))
    before = pieces.select("_file", "_start", F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file", "_start").orderBy("_id")  # one piece of a file
    placed = rows.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["_file", "_start"])
    return placed.select(*own, "_file", (F.col("_before") + F.col("_in")).cast("long").alias("_pos"))


def scan_pinned(spark: SparkSession, path: str, layout: Sequence[str], timestamp: str = S.TIMESTAMP, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """A table of one exact layout (14, 31, 61 or 81 columns, or 84 with labels); text that does not parse is an error.

    Empty cells are null. The schema is the layout's: a timestamp, text for labels, doubles for the rest.
    """
    raw = read_text_columns(spark, path)
    S.assert_layout(raw.drop("_file", "_pos"), layout)
    text = ("synthetic_anomaly_type", "synthetic_anomaly_id", "effect_context")
    cells, bad = [], {}
    for c in layout:
        given = F.col(c) if c in text else blank_to_null(F.col(c))
        read = parse_timestamp(F.trim(F.col(c)), pattern) if c == timestamp else given if c in text else parse_number(given)
        cells.append(read.alias(c))
        if c not in text:
            bad[f"unreadable_{c}"] = given.isNotNull() & read.isNull()
    demand(raw, bad)
    return raw.select(*cells, "_pos")


def number_duplicates(df: DataFrame, name: str) -> DataFrame:
    """df with the number (from 1, by _pos) of each row among those equal in every column but _pos and _file."""
    w = Window.partitionBy(*(c for c in df.columns if c not in ("_pos", "_file"))).orderBy("_pos")
    return df.withColumn(name, F.row_number().over(w))


def drop_duplicates(df: DataFrame, keep: str | bool = "first", key: Sequence[str] | None = None) -> DataFrame:
    """Rows equal in every column (but _pos): the first, the last, or none (keep=False) stays."""
    key = list(key or [c for c in df.columns if c not in ("_pos", "_file")])
    order = F.col("_pos").desc() if keep == "last" else F.col("_pos").asc()
    w = Window.partitionBy(*key)
    if keep is False:
        return df.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")
    return df.withColumn("_n", F.row_number().over(w.orderBy(order))).where("_n = 1").drop("_n")


def typed(rows: DataFrame, timestamp: str = S.TIMESTAMP, numeric: Sequence[str] | None = None, pattern: str = "d-M-yyyy H:m") -> DataFrame:
    """Text to values: bad timestamps and bad numbers become null."""
    numeric = [c for c in (numeric or rows.columns) if c not in (timestamp, "_pos")]
    return rows.select(*(parse_timestamp(F.trim(F.col(c)), pattern).alias(c) if c == timestamp else parse_number(blank_to_null(F.col(c))).alias(c) if c in numeric else F.col(c) for c in rows.columns))


def load(spark: SparkSession, path: str, timestamp: str = S.TIMESTAMP, numeric: Sequence[str] | None = None, pattern: str = "d-M-yyyy H:m", keep: str | bool | None = "first", sort: bool = True) -> DataFrame:
    """Typed rows without duplicates, in the order of (timestamp, nulls last; _pos)."""
    raw = read_text_columns(spark, path).drop("_file")
    S.require_columns(raw, [timestamp])
    rows = typed(drop_duplicates(raw, keep) if keep is not None else raw, timestamp, numeric, pattern)
    return rows.orderBy(F.col(timestamp).asc_nulls_last(), "_pos") if sort else rows
