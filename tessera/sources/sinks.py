"""Writers. Rows are written by Spark; only results that are small by their nature (reports, one JSON array) pass the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import blob_type
from tessera.operators.common import fresh, top_k
from tessera.operators.curate import sorted_by_number


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def json_array(df: DataFrame, path: str, limit: int = 1_000_000) -> int:
    """One file that is a JSON array, indented. The rows pass the driver one at a time; more than `limit` are refused."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows: write lines instead")
    store, name = pafs.FileSystem.from_uri(path)
    n = 0
    with store.open_output_stream(name) as f:
        f.write(b"[")
        for r in df.toJSON().toLocalIterator():
            body = json.dumps(json.loads(r), indent=4, ensure_ascii=False)
            f.write((("," if n else "") + "\n    " + body.replace("\n", "\n    ")).encode())
            n += 1
        f.write(b"\n]" if n else b"]")
    return n


def gathered(parts: Sequence[DataFrame], key: str = "item_id", seq: str = "seq") -> DataFrame:
    """The union of all writers' rows: of each key the first by writer and place, sorted by the key as a number if all are."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_writer", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return sorted_by_number(top_k(out, [key], ["_writer", seq]).drop("_writer"), key)


def counted_name(df: DataFrame, name: str) -> str:
    """The name with the number of rows."""
    return f"{name}_{df.count()}"


def split_pair(df: DataFrame, folder: str, column: str = "split") -> dict[str, str]:
    """One output a value of the split column, with its number of rows in the name."""
    counts = {r[column]: r["count"] for r in df.groupBy(column).count().collect()}
    out = {}
    for value, n in sorted(counts.items()):
        out[value] = f"{folder}/{value}_data_{n}"
        df.where(F.col(column) == value).drop(column).write.mode("overwrite").json(out[value])
    return out


def externalised(df: DataFrame, blobs: Sequence[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """df with each binary column replaced by the path of a file named by the content's SHA-1 and type, and the distinct
    blobs (path, content) that write_blobs() is to write. Blobs are told apart before anything is written, so a repeated one
    is written once."""
    out, found = df, None
    for c in blobs:
        path = F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{folder.rstrip('/')}/"), F.sha1(c), F.lit("."), blob_type(F.col(c))))
        part = df.where(F.col(c).isNotNull()).select(path.alias("path"), F.col(c).alias("content"))
        found = part if found is None else found.unionByName(part)
        out = out.withColumn(c, path)
    return out, found.groupBy("path").agg(F.first("content").alias("content"))


def write_blobs(blobs: DataFrame) -> int:
    """Write the blobs that do not exist yet; returns how many were new. A file gets its name when it is complete."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = 0
            for uri, content in zip(b["path"], b["content"], strict=True):
                store, name = pafs.FileSystem.from_uri(uri)
                if store.get_file_info(name).type == pafs.FileType.NotFound:
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(f"{name}.tmp") as f:
                        f.write(content)
                    store.move(f"{name}.tmp", name)
                    new += 1
            yield pd.DataFrame({"new": [new]})

    return int(blobs.mapInPandas(run, "new long").agg(F.sum("new")).first()[0] or 0)


def normalised_blobs(bytes_col: Column | None, path_col: Column | None) -> Column:
    """array<struct<bytes, path>> from a value given as bytes, as a path, or as both."""
    none = F.lit(None)
    return F.array(F.struct((bytes_col if bytes_col is not None else none.cast("binary")).alias("bytes"), (path_col if path_col is not None else none.cast("string")).alias("path")))


def normalised_values(df: DataFrame, name: str) -> Column:
    """array<struct<bytes, path>> of a column that holds bytes, a path, a struct with either or both, or an array of one of these; a column
    of another type is kept as it is. Null stays null."""

    def one(value: Column, kind: T.DataType) -> Column | None:
        none, fields = F.lit(None), kind.names if isinstance(kind, T.StructType) else []
        data = value if isinstance(kind, T.BinaryType) else value["bytes"] if "bytes" in fields else None
        path = value if isinstance(kind, T.StringType) else value["path"] if "path" in fields else None
        if data is None and path is None:
            return None
        made = F.struct((none.cast("binary") if data is None else data).alias("bytes"), (none.cast("string") if path is None else path).alias("path"))
        return F.when(value.isNotNull(), made)

    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: one(x, kind.elementType)) if one(value, kind.elementType) is not None else value
    made = one(value, kind)
    return value if made is None else F.when(value.isNotNull(), F.array(made))


def key_value_object(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row: a JSON object {key: value} in order of keys. It is one value, so it must fit in memory."""
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))))).alias("value"))


def text_lines(df: DataFrame, column: str, path: str, order: Sequence[str]) -> None:
    """One text file, lines by order, without a line end behind the last."""
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_output_stream(name) as f:
        for n, r in enumerate(df.orderBy(*order).select(column).toLocalIterator()):
            f.write(("\n" if n else "").encode() + (r[0] or "").encode())


def report(df: DataFrame, path: str, label: str = "score avg:") -> None:
    """A text file of one number."""
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_output_stream(name) as f:
        f.write(f"{label}{df.first()[0]}".encode())


def exactly(df: DataFrame, n: int) -> DataFrame:
    """df, once it is known to have n rows."""
    found = df.count()
    if found != n:
        raise ValueError(f"{found} rows where {n} are expected")
    return df


def checked(df: DataFrame, path: str, checks: dict[str, Column], form: str = "parquet") -> dict[str, int]:
    """Writes df to a new path, if no row fails a check: the rows for which each holds are counted as they are written, in the same
    pass, and a write with failed rows is taken back and raises. Returns the number of rows."""
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(f"failed_{k}") for k, c in checks.items()])
    marked.write.format(form).save(path)
    failed = {k: seen.get[f"failed_{k}"] for k in checks if seen.get[f"failed_{k}"]}
    if failed:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        raise ValueError(f"of {seen.get['rows']} rows failed: " + ", ".join(f"{k} {n}" for k, n in failed.items()))
    return {"rows": seen.get["rows"]}


def joined_complete(left: DataFrame, right: DataFrame, key: str, path: str, form: str = "parquet") -> dict[str, int]:
    """Writes the join of each left row with its right one; if a left row has none, nothing is left at the path."""
    [hit] = fresh([*left.columns, *right.columns], "hit")
    joined = left.join(right.withColumn(hit, F.lit(True)), key, "left").withColumn(hit, F.coalesce(hit, F.lit(False)))
    seen = Observation()
    rows = joined.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(hit)).alias("missing"))
    rows.where(hit).drop(hit).write.format(form).save(path)
    if seen.get["missing"]:
        at = left.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(left.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        raise KeyError(f"{seen.get['missing']} of {seen.get['rows']} rows have no match by {key}")
    return {"rows": seen.get["rows"]}


def spreadsheet(df: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """A CSV that spreadsheets open; more rows than they hold are refused."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True)


def scalars(df: DataFrame, step: str, path: str) -> None:
    """A metrics table (step, name, value), appended."""
    names = [c for c in df.columns if c != step]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")
    df.select(step, pairs).select(step, "m.name", "m.value").write.mode("append").parquet(path)


def masks(df: DataFrame, mask: str, path: str) -> None:
    """Arrays of 0 and 1 as small integers."""
    df.withColumn(mask, F.transform(mask, lambda x: (x != 0).cast("tinyint"))).write.mode("overwrite").parquet(path)
