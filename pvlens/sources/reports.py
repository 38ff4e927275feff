"""JSON and YAML scans, strict sinks, Markdown, and the quarantine of reviewed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite
from ..operators.gates import demand


def read_json_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row a file (or element of its outer array); broken files are an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_config(spark: SparkSession, path: str, required: Sequence[str] = ()) -> dict:
    """A YAML mapping, read through Spark so that any store works; needs PyYAML."""
    import yaml

    rows = spark.read.option("wholetext", True).text(path).take(2)
    if len(rows) != 1:
        raise ValueError("a configuration is one file")
    found = yaml.safe_load(rows[0].value)
    if not isinstance(found, dict) or (missing := [k for k in required if k not in found]):
        raise ValueError("not a mapping" if not isinstance(found, dict) else f"missing keys: {', '.join(missing)}")
    return found


def _doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def write_csv(df: DataFrame, path: str, timestamp: str = "yyyy-MM-dd HH:mm:ss", mode: str = "errorifexists") -> None:
    """CSV with a header; doubles are the shortest text that reads back equal, nulls are empty.

    The committer makes a finished folder visible as a whole.
    """
    df.write.mode(mode).option("header", True).option("timestampFormat", timestamp).option("timestampNTZFormat", timestamp).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines without NaN or infinities: they become null, and null fields are written."""
    doubles = set(_doubles(df))
    safe = [F.when(finite(F.col(c)), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    df.select(*safe).write.mode(mode).option("ignoreNullFields", False).json(path)


def quarantine_plan(review: DataFrame, files: DataFrame, root: str = "quarantine") -> DataFrame:
    """Moves of reviewed images and their empty labels; nothing is moved here.

    review: split, image_path, review_status, empty_label; files: path, length, sha256 and, if
    known, blank (only white space) of the dataset and of the quarantine. `problem` is the code of the first rule a row
    breaks, null if none: split, status, record, outside (not below its split's images), repeated, no_image, no_label,
    label_has_text, occupied (the target exists).
    """
    label = F.regexp_replace(F.regexp_replace("image_path", "/images/", "/labels/"), r"\.[^.]*$", ".txt")
    moved = lambda c: F.concat(F.lit(f"{root}/"), c)
    plan = review.groupBy("split", "image_path", "review_status", "empty_label").agg(F.count("*").alias("_times")).withColumn("label_path", label)
    for name, column in (("image", F.col("image_path")), ("label", F.col("label_path")), ("target_image", moved(F.col("image_path"))), ("target_label", moved(F.col("label_path")))):
        blank = F.col("blank") if "blank" in files.columns else F.lit(None).cast("boolean")
        own = files.select(F.col("path").alias(f"_{name}"), F.col("length").alias(f"_{name}_length"), blank.alias(f"_{name}_blank"), F.col("sha256").alias(f"{name}_sha256"))
        plan = plan.join(own, column == F.col(f"_{name}"), "left")
    inside = F.contains(F.concat(F.lit("/"), "image_path"), F.concat(F.lit("/"), "split", F.lit("/images/"))) & ~F.col("image_path").rlike(r"(^|/)\.\.(/|$)")
    empty = F.coalesce(F.col("_label_blank"), F.col("_label_length") == 0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "split": yes(F.col("split").isin("train", "val", "test")), "status": F.col("review_status").eqNullSafe("NEEDS_MANUAL_REVIEW"), "record": F.lower(F.col("empty_label").cast("string")).eqNullSafe("true"),
        "outside": yes(inside), "repeated": F.col("_times") == 1, "no_image": F.col("_image").isNotNull(), "no_label": F.col("_label").isNotNull(), "label_has_text": yes(empty), "occupied": F.col("_target_image").isNull() & F.col("_target_label").isNull(),
    }
    problem = F.get(F.filter(F.array(*(F.when(~kept, F.lit(code)) for code, kept in rules.items())), lambda x: x.isNotNull()), F.lit(0))
    return plan.select("split", "image_path", "label_path", moved(F.col("image_path")).alias("quarantine_image_path"), moved(F.col("label_path")).alias("quarantine_label_path"), "image_sha256", "label_sha256", problem.alias("problem"))


def image_files(spark: SparkSession, path: str, suffixes: Sequence[str] = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")) -> DataFrame:
    """path, length, sha256 of image files in any depth; contents never leave the scan."""
    glob = "*.{" + ",".join(x for s in suffixes for x in (s, s.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, sha256 of label files in any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """A log with blanks around its column names."""
    raw = spark.read.option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.toDF(*(c.strip() for c in raw.columns))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text (a report, a YAML configuration) as a folder with one file; the committer shows it whole or not at all."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def appended(raw: DataFrame, new: DataFrame, columns: Sequence[str], pos: str = "_pos") -> DataFrame:
    """The raw text of every prior field, unchanged, with new columns beside it; doubles are written with 17 digits, which read back equal.

    Rows meet on `pos`; one without a partner is an error.
    """
    kinds = dict(new.dtypes)
    cells = [(F.when(F.col(c).isNotNull(), F.format_string("%.17g", c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")).alias(c) for c in columns]
    joined = raw.join(new.select(F.col(pos).alias("_key"), *cells), F.col(pos) == F.col("_key"), "full")
    demand(joined, {"unmatched": F.col(pos).isNull() | F.col("_key").isNull()})
    return joined.select(pos, *(c for c in raw.columns if c not in (pos, "_file")), *columns)


def rewritten(raw: DataFrame, before: DataFrame, after: DataFrame, columns: Sequence[str], labels: Sequence[str] = (), pos: str = "_pos") -> DataFrame:
    """The raw text with only the cells of `columns` that differ between two tables written anew, and labels beside it."""
    old = before.select(F.col(pos).alias("_key"), *(F.col(c).alias(f"_old_{c}") for c in columns))
    new = after.select(F.col(pos).alias("_new_key"), *(F.col(c).alias(f"_new_{c}") for c in columns), *labels)
    joined = raw.join(old, F.col(pos) == F.col("_key"), "full").join(new, F.col(pos) == F.col("_new_key"), "full")
    demand(joined, {"unmatched": F.col(pos).isNull() | F.col("_key").isNull() | F.col("_new_key").isNull()})
    cell = lambda c: F.when(F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), F.col(c)).otherwise(F.format_string("%.17g", f"_new_{c}")).alias(c)
    return joined.select(pos, *(cell(c) if c in columns else F.col(c) for c in raw.columns if c not in (pos, "_file")), *labels)


def write_digits(df: DataFrame, path: str, pos: str | None = None) -> None:
    """CSV whose doubles have 17 significant digits."""
    kinds = dict(df.dtypes)
    cells = [(F.when(F.col(c).isNotNull(), F.format_string("%.17g", c)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in df.columns if c != pos]
    ordered = df.orderBy(pos) if pos else df
    ordered.select(*cells).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def markdown(title: str, tables: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A report of small tables; one of more than `most_rows` rows is an error, as it is no report."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows")
        text = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)] + ["| " + " | ".join(map(text, r)) + " |" for r in rows]
    return "\n".join(out) + "\n"


def carry_out(plan: DataFrame, manifest: str) -> int:
    """Move the files of a plan without problems, through Hadoop so that any store works, and write the manifest.

    A handful of reviewed files: every one is moved by the driver. If a move fails those done are moved back.
    """
    spark = plan.sparkSession
    rows = plan.collect()  # read once: the plan's own scans would miss the files that have moved
    if any(r.problem is not None for r in rows):
        raise ValueError("the plan has problems")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    moves = [pair for r in rows for pair in ((r.image_path, r.quarantine_image_path), (r.label_path, r.quarantine_label_path))]
    done: list[tuple[str, str]] = []

    def move(source: str, target: str) -> None:
        a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        fs = a.getFileSystem(conf)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"cannot move {source}")

    try:
        for source, target in moves:
            move(source, target)
            done.append((source, target))
        spark.createDataFrame(rows, plan.schema).coalesce(1).write.option("header", True).csv(manifest)
    except Exception:
        for source, target in reversed(done):
            move(target, source)
        raise
    return len(moves)
