"""Readers. Each gives rows an identity that does not depend on partitioning: file and line, file rank, or key.

Files are listed and read by Spark, so any store that it reaches will do. Lines are numbered in `lines`, tar and npz are read in
ranges in `archives`; npy, of which a file is one small mask, is read as binary and unpacked on the executors.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.common import running_number, top_k
from tessera.sources.archives import npz_rows, tar_samples
from tessera.sources.lines import lines


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, file_col: str | None = None) -> DataFrame:
    """An object a line; of one file, several, or whole directories."""
    df = spark.read.schema(schema).json(path)
    return df if file_col is None else df.withColumn(file_col, F.input_file_name())


def jsonl_roots(spark: SparkSession, roots: str, schema: T.StructType | str, separator: str = "^^") -> DataFrame:
    """All files of one or more folders, named in one text, with root and file: rows in the order of (root, file) are those of the
    folders one after another, each by its files' names."""
    made = None
    for k, folder in enumerate(roots.split(separator)):
        one = spark.read.schema(schema).json(folder).withColumn("root", F.lit(k)).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        made = one if made is None else made.unionByName(one)
    return made


def arrow_folder(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A dataset saved as Arrow streams or files, folder/*.arrow; the executors read them a batch at a time, which must have the columns of the schema."""
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    is_file = f.read(6) == b"ARROW1"
                    f.seek(0)
                    if is_file:
                        source = pa.ipc.open_file(f)
                        found = (source.get_batch(k) for k in range(source.num_record_batches))
                    else:
                        found = pa.ipc.open_stream(f)
                    for x in found:
                        yield x.select(names)

    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(folder).select("path")
    return paths.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(run, schema)


def jsonl_keyed(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """One row a key, the last line of each, sorted by key."""
    rows = lines(spark, path).withColumn("_r", F.from_json("text", schema)).select("file", "line", "_r.*")
    return top_k(rows, [key], [F.desc("file"), F.desc("line")]).drop("file", "line").orderBy(key)


def jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the malformed lines, which thereby can be counted."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where(F.col("_r._corrupt").isNull()).select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where(F.col("_r._corrupt").isNotNull()).select("value")


def json_map(spark: SparkSession, path: str, value: T.StructType, key: str = "id") -> DataFrame:
    """A file that is one object {id: record}."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias(key, "_r"))
    return whole.select(key, "_r.*")


def line_slice(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    return lines(spark, path).where((F.col("line") >= start) & (F.col("line") < stop))


def documents_per_file(spark: SparkSession, path: str) -> DataFrame:
    """idx (rank of the file's name from 0), stem and text, one row a file."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return running_number(whole, ["file"], "idx").select("idx", F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("value").alias("text"))


def category_lines(spark: SparkSession, folder: str, categories: Sequence[str], suffix: str = "") -> DataFrame:
    """category, caption, idx of one text file a category; idx restarts in each."""
    out = None
    for c in categories:
        rows = lines(spark, f"{folder}/{c}{suffix}.txt").select(F.lit(c).alias("category"), F.col("text").alias("caption"), F.col("line").alias("idx"))
        out = rows if out is None else out.unionByName(rows)
    return out


def table_text(spark: SparkSession, path: str, schema: str, sep: str = "\t", columns: Sequence[str] = (), base64_col: str | None = None, line_ends_in_fields: bool = True) -> DataFrame:
    """TSV or CSV with a header; a column may be base64. Fields may hold line ends in quotes, and then a file is one task's; a file without
    such fields is read by many."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, multiLine=line_ends_in_fields, escape='"')
    if base64_col:
        df = df.withColumn(base64_col, F.unbase64(base64_col))
    return df.select(*columns) if columns else df


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """image_id and caption of each annotation of a caption file."""
    df = spark.read.schema("annotations array<struct<image_id:long,caption:string>>").option("multiLine", True).json(path)
    return df.select(F.explode("annotations").alias("a")).select("a.image_id", "a.caption")


def parquet(spark: SparkSession, path: str, name_glob: str | None = None) -> DataFrame:
    """All files of a folder whose names match; train*.parquet for those with a prefix."""
    reader = spark.read.option("recursiveFileLookup", True) if name_glob else spark.read
    return reader.option("pathGlobFilter", name_glob).parquet(path) if name_glob else reader.parquet(path)


IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tif")


def files(spark: SparkSession, folder: str, extensions: Sequence[str] = IMAGES) -> DataFrame:
    """path, name, stem, extension (lower case), modified and length of files below a folder; the content is never read. Empty files
    are not listed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    made = df.select("path", name.alias("name"), F.regexp_extract(name, r"(.*?)(?:\.[^.]*)?$", 1).alias("stem"), ext.alias("extension"), F.col("modificationTime").alias("modified"), "length")
    return made.where(F.col("extension").isin(*extensions))


def class_folders(spark: SparkSession, folder: str) -> DataFrame:
    """files() with the folder's name as class, and its rank among the classes as label from 0."""
    df = files(spark, folder).withColumn("class", F.element_at(F.split("path", "/"), -2))
    ranks = running_number(df.select("class").distinct(), ["class"], "label")
    return df.join(ranks, "class")


def mask_index(spark: SparkSession, folder: str, suffix: str = "_mask.pt") -> DataFrame:
    """Distinct category, item_id and stem of all mask files, from their paths category/item_id/stem_mask.pt."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    parts = F.split("path", "/")
    return df.select(F.element_at(parts, -3).alias("category"), F.element_at(parts, -2).alias("item_id"), F.regexp_replace(F.element_at(parts, -1), re.escape(suffix) + "$", "").alias("stem")).distinct()


def latest(df: DataFrame) -> DataFrame:
    """The newest of files(), by time, then path."""
    return df.orderBy(F.desc("modified"), "path").limit(1)


def braces(pattern: str) -> list[str]:
    """a{000..002}b and a{x,y}b written out; `::` joins several patterns."""
    out: list[str] = []
    for one in pattern.split("::"):
        pieces = re.split(r"\{([^{}]*)\}", one)
        choices: list[list[str]] = []
        for k, p in enumerate(pieces):
            if k % 2 == 0:
                choices.append([p])
            elif m := re.fullmatch(r"(\d+)\.\.(\d+)", p):
                choices.append([str(i).zfill(len(m[1])) for i in range(int(m[1]), int(m[2]) + 1)])
            else:
                choices.append(p.split(","))
        out += ["".join(c) for c in product(*choices)]
    return out


def shards(spark: SparkSession, patterns: str, weights: Sequence[float] = ()) -> DataFrame:
    """url and weight of each shard; a pattern's weight goes to all its urls."""
    parts = patterns.split("::")
    if weights and len(weights) != len(parts):
        raise ValueError("one weight a pattern is needed")
    rows = [(u, float(w)) for p, w in zip(parts, weights or [1.0] * len(parts), strict=True) for u in braces(p)]
    return spark.createDataFrame(rows, "url string, weight double")


def first_of(parts: str, extensions: Sequence[str]) -> Column:
    """The first available of several extensions."""
    return F.coalesce(*[F.element_at(parts, F.lit(e)) for e in extensions])


def npy_masks(spark: SparkSession, path: str, size: int = 576, side: int = 24) -> DataFrame:
    """path and mask (flat) of npy files of `size` values or side x side; others give an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            masks, errors = [], []
            for content in b["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                good = a.shape in ((size,), (side, side))
                masks.append(a.reshape(-1).astype(float).tolist() if good else None)
                errors.append(None if good else f"shape {a.shape}")
            yield pd.DataFrame({"path": b["path"], "mask": masks, "error": errors})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, mask array<double>, error string")


def synthetic(spark: SparkSession, n: int, **columns: object) -> DataFrame:
    """n equal rows, numbered by id."""
    return spark.range(n).withColumns({k: F.lit(v) for k, v in columns.items()})


def size_of(spark: SparkSession, path: str, sizes: dict[str, int] | None = None) -> int:
    """Rows of Parquet files: from known sizes by file name if all are known, else from the footers."""
    if sizes is not None:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
        known = spark.createDataFrame(list(sizes.items()), "name string, n long")
        found = names.join(known, "name", "left").agg(F.count_if(F.col("n").isNull()).alias("unknown"), F.sum("n").alias("n")).first()
        if not found.unknown:
            return found.n or 0
    return spark.read.parquet(path).count()


READERS: dict[str, Callable[..., DataFrame]] = {"csv": lambda s, p, schema: table_text(s, p, schema, ","), "tsv": table_text, "tar": lambda s, p, schema=None: tar_samples(s, p), "npz": lambda s, p, schema=None: npz_rows(s, p)}


def read_by_extension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    ext = path.rpartition(".")[2].lower()
    if ext not in READERS:
        raise ValueError(f"no reader for .{ext}")
    return READERS[ext](spark, path, schema)


class Registry:
    """Named datasets: a name to a function of (spark, **options)."""

    def __init__(self):
        self._makers: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str, make: Callable[..., DataFrame]) -> None:
        self._makers[name] = make

    def read(self, spark: SparkSession, name: str, **options) -> DataFrame:
        if name not in self._makers:
            raise KeyError(f"unknown dataset {name!r}; known: {', '.join(sorted(self._makers))}")
        return self._makers[name](spark, **options)
