"""Streams whose output grows in a journal: append with resume, distinct values up to a number, and a loop fed by its own output.

A journal is a folder of `batch=<n>` tables. A batch is written whole and in place of any earlier try of the same batch, and a batch
reads only those before it. So a run that is killed and started again writes what one run would have written, whatever it had
reached: no row twice, none lost. A batch of the engine that brings nothing new leaves an empty entry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.common import fresh, running_number, top_k
from tessera.operators.curate import LIMIT_ROWS

#: Seconds between looks at a query that may have reached its number.
LOOK = 0.2


class Journal:
    """Batches of rows with one schema."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        [self.batch] = fresh(schema.names, "batch")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def read(self, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.batch, T.LongType())])).parquet(self.folder)
        return (rows if before is None else rows.where(F.col(self.batch) < before)).drop(self.batch)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*[f"`{c}`" for c in self.schema.names]).write.mode("overwrite").parquet(f"{self.folder}/{self.batch}={batch}")

    def rows(self, before: int | None = None) -> int:
        return self.read(before).count()

    def last(self) -> int:
        """Number of the last batch, or -1. A batch counts when its writer has marked it as whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.batch}=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return max([int(s.getPath().getParent().getName().partition("=")[2]) for s in found], default=-1)


def new_rows(rows: DataFrame, known: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by the order, of each key that is not known."""
    return top_k(rows.join(known.select(*keys), list(keys), "left_anti"), list(keys), list(order))


def first_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows by the order, without gathering many in one task."""
    if n <= LIMIT_ROWS:
        return rows.orderBy(*order).limit(n)
    [place] = fresh(rows.columns, "place")
    return running_number(rows, list(order), place).where(F.col(place) < n).drop(place)


def append_new(stream: DataFrame, journal: Journal, keys: Sequence[str], order: Sequence[str], checkpoint: str, answer: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
    """Rows whose key has no output yet, through answer (which adds what an outer system says), into the journal. Keys that are
    known are not asked again, also if another run wrote them. To resume, start it again with the same checkpoint."""

    def write(rows: DataFrame, batch: int) -> None:
        journal.write(answer(new_rows(rows, journal.read(batch), keys, order)), batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_until(stream: DataFrame, journal: Journal, keys: Sequence[str], order: Sequence[str], most: int, checkpoint: str) -> int:
    """The first `most` distinct keys of the stream, in the order of arrival, into the journal; then the stream stops. Within a
    batch rows arrive by the order, so the rows do not depend on how the input is cut into batches. Returns how many there are."""

    def write(rows: DataFrame, batch: int) -> None:
        missing = most - journal.rows(batch)
        if missing > 0:
            journal.write(first_rows(new_rows(rows, journal.read(batch), keys, order), order, missing), batch)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    seen = None
    while query.isActive and not query.awaitTermination(LOOK):
        last = query.lastProgress
        done = last["batchId"] if last else None
        if done != seen and journal.rows() >= most:  # counted once a batch
            query.stop()
        seen = done
    if query.exception():
        raise query.exception()
    return journal.rows()


def feedback(journal: Journal, make: Callable[[int, DataFrame], DataFrame], keys: Sequence[str], order: Sequence[str], most: int, rounds: int, interval: int = 1) -> int:
    """Rounds of make(round, examples) until the journal has `most` distinct keys or the rounds are over. Examples are the rows
    accepted in the rounds before, refreshed every `interval` rounds. A loop that is started again goes on behind its last whole
    round. Returns how many rows there are."""
    for k in range(journal.last() + 1, rounds):
        have = journal.rows(k)
        if have >= most:
            break
        examples = journal.read(k - k % interval)
        journal.write(first_rows(new_rows(make(k, examples), journal.read(k), keys, order), order, most - have), k)
    return journal.rows()
