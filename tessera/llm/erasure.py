"""Cascading erasure: tables laid out as files of a fixed number of rows, from which the rows of some people are taken again.

lay_out() sorts a table by given keys and then by all its columns, and writes it as Parquet files of 1 + floor(n / 250)
consecutive rows. The running number of a row comes from ranges of the sort (`operators.common.numbered`: equal rows and hot keys
are cut, too); each file is exactly one partition (repartitionById), sorted within, staged by partitionBy and then renamed to its
place, so that a reader sees all files or none. A file is the folder `<table>/file_no=<k>/`.

erase() finds the files that hold rows with one of the given keys, writes the other rows of these files, in their order, and puts
them in place by a dynamic partition overwrite: the files that held no such row are not touched, and the footers of the new files
know of no other rows. Folders of files that held nothing else are deleted. A run that is repeated after a loss finds what is
left to do: both steps change nothing where no such row remains.

report() reads the files back: one task streams each file in the order of its rows.

What goes to the driver is counts by file, at most 250 a table. Who is erased is a table, and joined as one.

Edge cases: a table without rows has no files; null keys match no key, and a sale line without a sale or client sorts by the empty
string; rows that are equal in all columns are rows of their own and are erased alike; of several sales with one id the smallest
client sorts their lines, and a line goes if any of them does; amounts that are null or not finite count 0; a column named as the
partition column makes that one longer; texts may be empty or of any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.shared import column, new_path, stored
from tessera.operators.common import fresh, numbered

#: Files of a table are of 1 + floor(n / FILES) rows.
FILES = 250
#: Masters whose crc32 this divides are erased.
DIVISOR = 200
REPORT = "file_no long, n_rows long, cents long, ids_sha256 string, path string"


@dataclass(frozen=True)
class Laid:
    """A table as numbered files: the folder that holds them, its own columns, and the name of the partition column."""

    spark: SparkSession
    name: str
    folder: str
    schema: StructType
    number: str
    files: int

    def read(self) -> DataFrame:
        """Its rows, with the number of the file of each."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(self.number, LongType())])).parquet(self.folder)


def quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def crc(key: Column) -> Column:
    """crc32 of the key as decimal text; null is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _written(rows: DataFrame, files: int, number: str, order: str):
    """A writer of exactly one file for each file number, its rows in the given order."""
    dealt = rows.repartitionById(max(files, 1), F.col(number).cast("int")).sortWithinPartitions(number, order).drop(order)
    options = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "maxRecordsPerFile": "0", "partitionOverwriteMode": "dynamic"}
    return dealt.write.options(**options).partitionBy(number)


def lay_out(df: DataFrame, name: str, folder: str, order: Sequence[Column] = (), files: int = FILES, unwritten: Sequence[str] = ()) -> Laid:
    """df as files below folder, sorted by the order and then by all columns, ascending, nulls first. Unwritten columns serve the
    order only."""
    spark = df.sparkSession
    place, number = fresh(df.columns, "place", "file_no")
    own = [c for c in df.columns if c not in unwritten]
    rows = numbered(df, [*order, *quoted(own)], place).drop(*unwritten)
    n = rows.count()
    size = 1 + n // files
    laid = Laid(spark, name, f"{folder}/{name}", StructType([f for f in df.schema.fields if f.name in own]), number, math.ceil(n / size))
    staging, fs = _at(spark, f"{folder}-staging/{name}")
    fs.mkdirs(staging)
    _written(rows.withColumn(number, F.floor(F.col(place) / size).cast("long")), laid.files, number, place).mode("append").parquet(staging.toString())
    final, _ = _at(spark, laid.folder)
    fs.mkdirs(final.getParent())
    if not fs.rename(staging, final):
        raise OSError(f"{staging} cannot be renamed to {final}")
    return laid


def erase(laid: Laid, key: str, gone: DataFrame) -> dict[int, int]:
    """Takes the rows whose key is among those of gone (one column of distinct keys) from the files; number of rows taken from
    each file that held some."""
    [hit, at] = fresh([*laid.schema.names, laid.number, *gone.columns], "hit", "at")
    [gone_key] = fresh([*laid.schema.names, laid.number], "gone_key")
    keys = gone.toDF(gone_key)
    rows = laid.read()
    same = rows[f"`{key}`"] == keys[gone_key]
    met = rows.select(f"`{key}`", laid.number).join(keys.withColumn(hit, F.lit(1)), same, "left")
    counts = met.groupBy(laid.number).agg(F.count("*").alias("n"), F.count(hit).alias("gone")).where("gone > 0").collect()  # a row a file
    emptied = [r[laid.number] for r in counts if r.n == r.gone]
    changed = [r[laid.number] for r in counts if r.n > r.gone]
    if changed:
        held = rows.where(F.col(laid.number).isin(changed)).select("*", F.col("_metadata.row_index").alias(at))
        left = held.join(keys, held[f"`{key}`"] == keys[gone_key], "left_anti")
        _written(left, laid.files, laid.number, at).mode("overwrite").parquet(laid.folder)
    for k in emptied:
        path, fs = _at(laid.spark, f"{laid.folder}/{laid.number}={k}")
        fs.delete(path, True)
    return {r[laid.number]: r.gone for r in counts}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by file and place: a row a file, its ids hashed as they pass."""
    held, n, cents, path, sha = None, 0, 0, "", hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file_no": [held], "n_rows": [n], "cents": [cents], "ids_sha256": [sha.hexdigest()], "path": [path]}, pa.schema([("file_no", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string()), ("path", pa.string())]))

    for b in batches:
        numbers = column(b, "file_no").to_numpy()
        start = 0
        while start < len(numbers):
            stop = start + int((numbers[start:] != numbers[start]).argmax() or len(numbers) - start)
            if numbers[start] != held:
                if held is not None:
                    yield row()
                held, n, cents, path, sha = int(numbers[start]), 0, 0, column(b, "path")[start].as_py(), hashlib.sha256()
            ids = ",".join(column(b, "id").slice(start, stop - start).to_pylist())
            sha.update(("," if n else "").encode() + ids.encode())
            n += stop - start
            cents += sum(column(b, "cents").slice(start, stop - start).to_pylist())
            start = stop
    if held is not None:
        yield row()


def cents(amount: Column) -> Column:
    """Hundredths, rounded half up; 0 for what is null or not finite."""
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    return F.when(finite, F.floor(F.lit(100.0) * amount + F.lit(0.5))).otherwise(F.lit(0)).cast("long")


def report(laid: Laid, erased: dict[int, int], amount: str) -> DataFrame:
    """A row a file that is there now: file_no, n_rows, n_erased, cents, rewritten, table_name, ids_sha256, columns, path."""
    spark = laid.spark
    rows = laid.read().select(
        F.col(laid.number).alias("file_no"), F.col("_metadata.row_index").alias("at"), F.col("_metadata.file_path").alias("path"),
        F.coalesce(quoted(laid.schema.names[:1])[0].cast("string"), F.lit("")).alias("id"), cents(F.col(f"`{amount}`").cast("double")).alias("cents"),
    )
    tasks = max(1, min(laid.files, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    streamed = rows.repartitionById(tasks, (F.col("file_no") % tasks).cast("int")).sortWithinPartitions("file_no", "at").mapInArrow(_digests, REPORT)
    taken = F.broadcast(spark.createDataFrame(list(erased.items()), "file_no long, n_erased long"))  # at most FILES rows
    n = F.coalesce("n_erased", F.lit(0).cast("long"))
    return streamed.join(taken, "file_no", "left").select(
        "file_no", "n_rows", n.alias("n_erased"), "cents", (n > 0).alias("rewritten"), F.lit(laid.name).alias("table_name"), "ids_sha256", F.lit(",".join(laid.schema.names)).alias("columns"), "path"
    )


def chosen_masters(clients: DataFrame, clicks: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """master_id: those whose crc32 the divisor divides, and the one whose clients together have most clicks (of several the
    smallest, also where none has any)."""
    of = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    counted = clicks.where("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    by_master = of.join(counted, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    first = by_master.agg(F.min(F.struct((-F.col("n")).alias("n"), "master_id")).alias("m")).select("m.master_id").where("master_id is not null")
    return by_master.where(crc(F.col("master_id")) % divisor == 0).select("master_id").unionByName(first).distinct()


def erasure(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, divisor: int = DIVISOR, files: int = FILES) -> DataFrame:
    """Lays the four tables out in a new folder, erases the chosen masters' clients with all that hangs on them, and reports the
    files that are left."""
    spark = clients.sparkSession
    folder = new_path(spark, "erasure")
    # written first: a join of two plain shuffles is one that Spark can split where a sale has very many lines
    of_sale = stored(sales.where("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("of_client")), "sale-clients")
    key, sale = fresh(sale_lines.columns, "of_client", "of_sale")
    keyed = sale_lines.join(of_sale.toDF(sale, key), F.col("sale_id") == F.col(sale), "left").select(*quoted(sale_lines.columns), crc(F.col(key)).alias(key))
    laid = {name: lay_out(df, name, folder, [crc(F.col("client_id"))], files) for name, df in (("clients", clients), ("clicks", clicks), ("sales", sales))}
    laid["sale_lines"] = lay_out(keyed, "sale_lines", folder, [F.col(key)], files, [key])

    masters = stored(chosen_masters(clients, clicks, divisor), "masters")
    people = stored(clients.join(masters, "master_id", "left_semi").where("client_id is not null").select("client_id").distinct(), "people")
    theirs = stored(sales.join(people, "client_id", "left_semi").where("sale_id is not null").select("sale_id").distinct(), "their-sales")
    steps = [("clients", "master_id", masters, "balance"), ("clicks", "client_id", people, "value"), ("sales", "client_id", people, "total"), ("sale_lines", "sale_id", theirs, "amount")]
    out = None
    for name, by, gone, amount in steps:
        files_of = report(laid[name], erase(laid[name], by, gone), amount)
        out = files_of if out is None else out.unionByName(files_of)
    return out
