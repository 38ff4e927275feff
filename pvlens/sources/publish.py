"""Publishing: a contract checked by the job that writes, files that appear whole or not at all, columns spliced into lines kept as bytes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import positions
from ..functions.scalars import finite
from ..functions.windows import seconds_between


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def rename(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """A rename within one file system. Without replace a target that exists is an error; a file is replaced in one step, a folder is removed first."""
    fs, old = _file_system(spark, source)
    _, new = _file_system(spark, target)
    if fs.exists(new):
        if not replace:
            raise FileExistsError(target)
        if fs.getFileStatus(new).isFile():
            hadoop = spark._jvm.org.apache.hadoop.fs
            how = getattr(hadoop, "Options$Rename")
            over = spark.sparkContext._gateway.new_array(how, 1)
            over[0] = how.OVERWRITE
            hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(old), fs.makeQualified(new), over)
            return
        fs.delete(new, True)
    if new.getParent() is not None:
        fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"{source} could not be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, found = _file_system(spark, path)
    fs.delete(found, True)


@dataclass(frozen=True)
class Contract:
    """What a table must be: so many rows, from one time to another, times present, each once in its series and a cadence apart, finite cells, no row of a check.

    series: the columns whose rows are one series; rows are then sorted by time in their series, before they are written.
    """

    ts: str | None = None
    series: Sequence[str] = ()
    rows: int | None = None
    first: str | None = None
    last: str | None = None
    unique: bool = False
    cadence: float | None = None
    finite: Sequence[str] = ()
    checks: dict[str, Column | str] = field(default_factory=dict)
    #: Of a part: (its rows, a column, the least and the greatest value that the part must have, how many rows).
    bounds: dict[str, tuple[Column, Column, str, str, int | None]] = field(default_factory=dict)

    def metrics(self) -> dict[str, Column]:
        found = {"rows": F.count(F.lit(1))}
        if self.ts:
            found |= {"first": F.min(self.ts).cast("string"), "last": F.max(self.ts).cast("string"), "missing_timestamp": F.count_if(F.col(self.ts).isNull())}
        if self.unique or self.cadence is not None:
            found["repeated_timestamp"] = F.count_if(F.col("_step") == 0)
        if self.cadence is not None:
            found["uneven_timestamp"] = F.count_if(F.col("_step") != self.cadence)
        for name, (own, value, _, _, _) in self.bounds.items():
            found |= {f"{name}.first": F.min(F.when(own, value)).cast("string"), f"{name}.last": F.max(F.when(own, value)).cast("string"), f"{name}.rows": F.count_if(own)}
        found |= {f"not_finite_{c}": F.count_if(~finite(F.col(c).cast("double"))) for c in self.finite}
        return found | {f"check_{k}": F.count_if(F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False))) for k, c in self.checks.items()}

    def broken(self, seen: dict) -> dict:
        """What was seen and should not have been."""
        declared = {k: getattr(self, k) for k in ("rows", "first", "last") if getattr(self, k) is not None}
        for name, (_, _, first, last, rows) in self.bounds.items():
            declared |= {f"{name}.first": first, f"{name}.last": last} | ({} if rows is None else {f"{name}.rows": rows})
        wrong = {k: seen.get(k) for k, v in declared.items() if seen.get(k) != v}
        facts = {"rows", "first", "last", *(f"{n}.{k}" for n in self.bounds for k in ("first", "last", "rows"))}
        return wrong | {k: n for k, n in seen.items() if k not in facts and n}


def publish(df: DataFrame, path: str, contract: Contract, mode: str = "error") -> DataFrame:
    """Write df as Parquet to `path` if the contract holds, and read it; a broken contract is an error and publishes nothing.

    One job: the metrics are gathered by the tasks that write (to a folder beside `path`), after the last shuffle, so
    a task that runs again counts once. The folder is renamed when they are right. mode: error or overwrite.
    """
    spark = df.sparkSession
    seen = Observation()
    rows = df
    if contract.unique or contract.cadence is not None:
        w = Window.partitionBy(*contract.series).orderBy(contract.ts)
        if not contract.series:  # one series: blocks of time, and the row before each block
            placed = positions(df, contract.ts, name="_place")
            last = placed.select((F.col("_place") + 1).alias("_place"), F.col(contract.ts).alias("_last"))
            rows = placed.join(last, "_place", "left").withColumn("_step", seconds_between(F.col(contract.ts), F.col("_last")))
        else:
            rows = df.withColumn("_step", seconds_between(F.col(contract.ts), F.lag(contract.ts).over(w)))
    staged = f"{path.rstrip('/')}.staged"
    rows.observe(seen, *(c.alias(k) for k, c in contract.metrics().items())).select(*df.columns).write.mode("overwrite").parquet(staged)
    if wrong := contract.broken(seen.get):
        remove(spark, staged)
        raise ValueError("contract broken: " + ", ".join(f"{k} = {v}" for k, v in wrong.items()))
    rename(spark, staged, path, replace=mode == "overwrite")
    return spark.read.schema(df.schema).parquet(path)


def publish_lines(lines: DataFrame, path: str, line: str = "value", pos: str = "_pos", end: str = "\n") -> None:
    """One file of the lines in order of `pos`, written beside `path` and renamed over it: readers see the old file or the new one.

    A single file has one writer; a folder of files is the way for large tables.
    """
    spark = lines.sparkSession
    staged = f"{path}.staged"
    lines.select(line, pos).coalesce(1).sortWithinPartitions(pos).select(line).write.mode("overwrite").option("lineSep", end).text(staged)
    fs, folder = _file_system(spark, staged)
    (part,) = [str(x.getPath()) for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")]
    rename(spark, part, path, replace=True)
    remove(spark, staged)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _pos: the records of a delimited file as they stand, byte for byte, numbered from 0.

    Lines end at a line feed; a carriage return before it is part of the line. A line feed inside quotes does not end a
    record: lines are joined while the quotes met so far are odd. One file, read in splits; only counts of a split meet.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_at"))
    placed = raw.select("value", (F.col("_at.b") * 1.0).alias("_block"), F.col("_at.i").alias("_i"), (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes"))
    # Ids ascend within a split; splits are ordered by the byte they begin at.
    totals = placed.groupBy("_block").agg(F.sum("_quotes").alias("_q"), F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    shifts = totals.select("_block", F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_q0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_block").orderBy("_i")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    lines = placed.join(shifts, "_block").select("value", "_block", "_i", (F.col("_n0") + F.row_number().over(inside) - 1).alias("_line"), ((F.col("_q0") + F.coalesce(F.sum("_quotes").over(upto), F.lit(0))) % 2 == 0).alias("_starts"))
    if lines.where("not _starts").isEmpty():
        return lines.select("value", F.col("_line").alias("_pos"))
    begun = lines.groupBy("_block").agg(F.count_if("_starts").alias("_r")).select("_block", F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_r0"))
    count = F.sum(F.col("_starts").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.join(begun, "_block").select("value", "_line", (F.col("_r0") + count - 1).alias("_pos"))
    held = numbered.groupBy("_pos").agg(F.sort_array(F.collect_list(F.struct("_line", "value"))).alias("_all"))  # the lines of one record
    return held.select(F.array_join(F.transform("_all", lambda x: x["value"]), "\n").alias("value"), "_pos")


def spliced(lines: DataFrame, new: DataFrame, columns: Sequence[str], value: str = "value", pos: str = "_pos") -> DataFrame:
    """value, _pos: every record with the new columns' cells after its last byte (before a carriage return), the header with their names.

    lines: records numbered from 0, the header among them; new: rows numbered from 0. Doubles are written with 17
    digits; a cell that needs quotes gets them. Rows without a partner are an error when the result is written.
    """
    from ..operators.merkle import seventeen_digits

    kinds = dict(new.dtypes)
    plain = lambda c: seventeen_digits(F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    cells = new.select((F.col(pos) + 1).alias("_key"), F.concat(*(F.concat(F.lit(","), quoted(plain(c))) for c in columns)).alias("_cells"))
    joined = lines.join(cells, F.col(pos) == F.col("_key"), "full")
    names = F.lit("".join(f",{c}" for c in columns))
    alone = F.col(pos).isNull() | (F.col("_cells").isNull() & (F.col(pos) > 0))
    tail = F.when(alone, F.raise_error(F.lit("a row has no partner"))).when(F.col(pos) == 0, names).otherwise(F.col("_cells"))
    body = F.when(F.endswith(F.col(value), F.lit("\r")), F.concat(F.substring(F.col(value), F.lit(1), F.length(value) - 1), tail, F.lit("\r"))).otherwise(F.concat(F.col(value), tail))
    return joined.select(body.alias(value), F.coalesce(pos, "_key").alias(pos))
