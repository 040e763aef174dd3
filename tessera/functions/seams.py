"""The seam where a model turns one row into many candidates: a table function, called from SQL with PARTITION BY."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


def register_candidates(spark: SparkSession, name: str, load: Callable[[], Callable[[Row], Iterable[tuple]]], schema: str, most: int | None = None) -> None:
    """`name`(TABLE(t) PARTITION BY item ORDER BY ...) in SQL: the candidates of each row of t, numbered from 0 within the item.

    load() gives what makes a row's candidates (tuples of the schema), once a partition and on the executor, so that it may hold a
    model. With `most`, an item has so many at most, and the rows behind them are not asked. Rows pass one at a time.
    """

    class Candidates:
        def __init__(self):
            self.make, self.n = load(), 0

        def eval(self, row: Row):
            if most is None or self.n < most:
                for candidate in self.make(row):
                    if most is None or self.n < most:
                        yield (self.n, *candidate)
                        self.n += 1

    spark.udtf.register(name, udtf(Candidates, returnType=f"slot long, {schema}"))
