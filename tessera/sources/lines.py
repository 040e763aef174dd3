"""Lines with their place in the file, where many tasks read one file.

A file is cut into byte ranges by Spark's text reader; the lines of a range come in order. One pass counts the lines of each
range, sums of the counts tell with which line a range begins, and a second pass numbers the lines: no task sees a whole file, no
file is a row, and nothing but a row a range is shuffled. (Compressed files are one range each.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.common import laid_out

#: Ranges are sent to all tasks up to this number (some 10 MB); beyond it they are joined.
SENT_RANGES = 100_000


def stem_of(file: str):
    return F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1)


def scanned(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, range (its first byte), at (rises within a range) and text of each line; lines end at \\n or \\r\\n."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", r"\r\z", "").alias("text"),
    )


def ranges(rows: DataFrame) -> DataFrame:
    """file, range, first (its smallest at), before (lines of the file that stand before it)."""
    counts = rows.groupBy("file", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return laid_out(counts.select("file", "range", "first", F.coalesce(before, F.lit(0)).alias("before")))


def lines(spark: SparkSession, path: str | list[str], start: int = 0) -> DataFrame:
    """file, stem, line (from start), text of each line; a final line end begins no line, an empty file has none.

    Both passes read the same ranges: while the result is in use, the files and the settings that cut them must stay.
    """
    rows = scanned(spark, path)
    places = ranges(rows)
    few = places.limit(SENT_RANGES + 1).count() <= SENT_RANGES
    joined = rows.join(F.broadcast(places) if few else places, ["file", "range"])
    return joined.select("file", stem_of("file").alias("stem"), (F.col("at") - F.col("first") + F.col("before") + start).cast("long").alias("line"), "text")
