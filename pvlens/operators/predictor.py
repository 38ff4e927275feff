"""A predictor of one's own inside SQL: a table function over the ordered rows of each partition.

    register(spark, "predict", lambda x: 2 * x["a"], ["a"])
    SELECT * FROM predict(TABLE(t) PARTITION BY series ORDER BY n)

The predictor gets frames of up to `batch` rows and returns a number for each; every `stride`-th row of a partition is analysed, the
others pass without a score. `running` counts the analysed rows so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

RETURNS = "series string, place long, analysed boolean, running long, score double"


def predictor(predict: Callable[[pd.DataFrame], Sequence[float]], inputs: Sequence[str], series: str = "series", place: str = "n", stride: int = 1, batch: int = 1024):
    """The table function: series, place, analysed, running, score of each row; a null or NaN prediction is a null score."""
    if stride < 1:
        raise ValueError("the stride must be positive")

    class Predictor:
        def __init__(self):
            self.rows: list[tuple] = []
            self.seen = self.running = 0

        def eval(self, row: Row) -> Iterator[tuple]:
            analysed = self.seen % stride == 0
            self.seen += 1
            self.running += analysed
            self.rows.append((str(row[series]), row[place], analysed, self.running, tuple(row[c] for c in inputs) if analysed else None))
            if len(self.rows) >= batch:
                yield from self.flush()

        def terminate(self) -> Iterator[tuple]:
            yield from self.flush()

        def flush(self) -> Iterator[tuple]:
            frame = pd.DataFrame([r[4] for r in self.rows if r[2]], columns=list(inputs))
            found = iter(predict(frame) if len(frame) else ())
            for name, at, analysed, running, _ in self.rows:
                score = next(found) if analysed else None
                yield name, at, analysed, running, None if score is None or pd.isna(score) else float(score)
            self.rows = []

    return udtf(Predictor, returnType=RETURNS)


def register(spark: SparkSession, name: str, predict: Callable[[pd.DataFrame], Sequence[float]], inputs: Sequence[str], **options) -> None:
    spark.udtf.register(name, predictor(predict, inputs, **options))
