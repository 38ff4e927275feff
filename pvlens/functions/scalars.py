"""Column functions with the engine's null and zero discipline: NaN never enters, x / 0 is null."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Texts that mean "missing" in delimited files.
MISSING = ("", "#N/A", "N/A", "NA", "NaN", "None", "NULL", "nan", "null", "n/a", "<NA>")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def parse_number(c: Column) -> Column:
    """Double of a plain decimal text, else null; infinities count as invalid text."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def parse_timestamp(c: Column, pattern: str = "d-M-yyyy H:m") -> Column:
    """A naive timestamp, read as it stands: no zone has a part in it, so hours that a zone skips exist. Null where the text does not fit.

    pattern: d, M, yyyy, H, m, s, doubled for two digits; anything else stands for itself.
    """
    pieces = re.findall(r"([dMyHms])(\1*)|([^dMyHms]+)", pattern)
    shape = "".join(re.escape(other) if other else rf"(\d{{{len(more) + 1}}})" if more else r"(\d{1,2})" for _, more, other in pieces)
    letters = [letter for letter, _, other in pieces if not other]
    # One match for all parts; a text that does not fit has none.
    parts = F.split(F.when(c.rlike(f"^{shape}$"), F.regexp_replace(c, f"^{shape}$", " ".join(f"${i + 1}" for i in range(len(letters))))), " ")
    part = lambda x: parts[letters.index(x)].try_cast("int") if x in letters else F.lit(0)
    return F.try_make_timestamp_ntz(part("y"), part("M"), part("d"), part("H"), part("m"), part("s").cast("decimal(16,6)"))


def blank_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*MISSING), c)


def safe_ratio(num: Column, den: Column, floor: float) -> Column:
    if floor <= 0:
        raise ValueError("the floor must be positive")
    return F.when(F.abs(den) >= floor, num / den)


def safe_relative_change(value: Column, previous: Column, floor: float) -> Column:
    return safe_ratio(value - previous, previous, floor)


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    angle = c * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def row_stats(values: Column) -> dict[str, Column]:
    """Mean, population deviation, min, max, range over an array's non-null elements."""
    kept = F.filter(values, lambda x: x.isNotNull())
    n = F.size(kept)
    mean = F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / n)
    var = F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    return {"mean": mean, "std": F.sqrt(var), "min": F.array_min(kept), "max": F.array_max(kept), "range": F.array_max(kept) - F.array_min(kept)}


def column_stats(columns: Sequence[str]) -> dict[str, Column]:
    """`row_stats` over named columns, without an array made for every row; the same sums in the same order."""
    cells = [F.col(c) for c in columns]
    n = sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))
    some = F.when(n > 0, n)
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in cells), F.lit(0.0)) / some
    var = sum((F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cells), F.lit(0.0)) / some
    least, most = F.least(*cells), F.greatest(*cells)
    return {"mean": mean, "std": F.sqrt(var), "min": least, "max": most, "range": most - least}


def corr(a: Column, b: Column) -> Column:
    """Pearson over pairwise complete rows; null where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(den > 1e-12, F.try_divide(F.covar_pop(x, y), den))


def close(a: Column, b: Column, rtol: float = 1e-12, atol: float = 1e-10) -> Column:
    return F.coalesce((a.isNull() & b.isNull()) | (F.abs(a - b) <= atol + rtol * F.abs(b)), F.lit(False))


def different(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def status(score: Column, threshold: float | Column) -> Column:
    """Strictly above the threshold is an alert; a score that is null or NaN has no status."""
    return F.when(score.isNull() | F.isnan(score), F.lit(None)).when(score > threshold, "ALERT").otherwise("NORMAL")


def category(c: Column, cases: Sequence[tuple[Column, str]], other: str) -> Column:
    out = F.lit(other)
    for when, name in reversed(cases):
        out = F.when(when, name).otherwise(out)
    return out
