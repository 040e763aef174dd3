"""Tar shards and npz arrays, read in ranges: several tasks share one file, and no file is held whole.

Planning reads only headers. Of a tar shard these give the offsets of its members, and the shard is cut between samples into
ranges of about CHUNK bytes; of a stored npz member they give the offset of any row, and it is cut into ranges of rows. Each range
is read by a seek. Planning is itself a Spark stage, a task a file, which returns a row a range; the ranges are then dealt out
by their sizes. For SQL and spark.read the same is offered as Python data sources (`register`), which plan on the driver and
so suit some thousands of files.

A sample is a run of members with one key; a member whose extension the sample already has begins the next. What cannot be read
is a row of its own with an error, and the rest of the shard is still read. Files are opened by pyarrow's file systems.
"""

from __future__ import annotations

import fnmatch
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of the samples that are handed on at once.
CHUNK = 64 << 20
BATCH = 8 << 20
RANGE = "path string, start long, stop long"
#: A name's folders and base up to the first dot are its key, the rest its extension.
MEMBER = re.compile(r"^((?:.*/)?[^./][^./]*)\.([^/]*)$")


def opened(path: str):
    store, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store.open_input_file(inner)


def _key(name: str) -> tuple[str, str] | None:
    m = MEMBER.match(name)
    return (m[1], m[2].lower()) if m else None


@dataclass
class Hole:
    """Bytes of a shard that are no member."""

    offset: int
    error: str


def _padded(m: tarfile.TarInfo) -> int:
    return m.offset_data + -(-m.size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE


def _only_zeros(f, start: int, stop: int) -> bool:
    f.seek(start)
    while start < stop:
        part = f.read(min(1 << 20, stop - start))
        if not part or part.strip(b"\0"):
            return not part
        start += len(part)
    return True


def _members(f, start: int, stop: int) -> Iterator[tarfile.TarInfo | Hole]:
    """Members whose headers begin in [start, stop), from their headers alone, and holes between them."""
    size = f.size()
    f.seek(start)
    at = start
    try:
        # zero blocks and broken headers are stepped over: what lies behind them is still found
        with tarfile.open(fileobj=f, mode="r:", ignore_zeros=True) as t:
            while (m := t.next()) is not None:
                t.members = []  # a shard may have millions
                if m.offset >= stop:
                    at = stop
                    break
                back = f.tell()
                if m.offset > at and not _only_zeros(f, at, m.offset):
                    yield Hole(at, "no member of the archive")
                f.seek(back)
                at = _padded(m)
                yield m
                f.seek(back)
    except tarfile.TarError as e:
        if at == start:
            yield Hole(at, str(e))
            return
    if at < min(stop, size) and not _only_zeros(f, at, min(stop, size)):
        yield Hole(at, "no member of the archive")


def tar_ranges(path: str, chunk: int = CHUNK) -> Iterator[tuple[str, int, int]]:
    """path, start and stop of ranges of whole samples."""
    with opened(path) as f:
        size, start, key, seen = f.size(), 0, None, set()
        for m in _members(f, 0, size):
            new = None if isinstance(m, Hole) else _key(m.name)
            if isinstance(m, Hole) or (new and (new[0] != key or new[1] in seen)):
                if m.offset - start >= chunk:
                    yield path, start, m.offset
                    start = m.offset
                key, seen = (new[0] if new else None), set()
            if new:
                seen.add(new[1])
        yield path, start, size


SAMPLE = "__key__ string, __url__ string, parts array<struct<key:string,value:binary>>, error string"
_SAMPLE = pa.schema([("__key__", pa.string()), ("__url__", pa.string()), ("parts", pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))), ("error", pa.string())])


def _tar_rows(path: str, start: int, stop: int) -> Iterator[tuple[dict, int]]:
    key, parts, held = None, {}, 0

    def sample() -> tuple[dict, int]:
        return {"__key__": key, "__url__": path, "parts": [{"key": k, "value": v} for k, v in parts.items()], "error": None}, held

    with opened(path) as f:
        for m in _members(f, start, stop):
            if isinstance(m, Hole):
                if parts:
                    yield sample()
                    key, parts, held = None, {}, 0
                yield {"__key__": None, "__url__": path, "parts": [], "error": f"byte {m.offset}: {m.error}"}, 0
            elif m.isfile() and (named := _key(m.name)):
                if named[0] != key or named[1] in parts:
                    if parts:
                        yield sample()
                    key, parts, held = named[0], {}, 0
                f.seek(m.offset_data)
                body = f.read(m.size)
                if len(body) < m.size:
                    yield {"__key__": key, "__url__": path, "parts": [], "error": f"{m.name}: {len(body)} of {m.size} bytes"}, 0
                else:
                    parts[named[1]] = body
                    held += m.size
    if parts:
        yield sample()


def tar_read(path: str, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """Samples of a range, a batch for each BATCH bytes."""
    rows, held = [], 0
    for row, size in _tar_rows(path, start, stop):
        rows.append(row)
        held += size
        if held >= BATCH:
            yield pa.RecordBatch.from_pylist(rows, _SAMPLE)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SAMPLE)


ROWS = "file string, row long, values array<double>, error string"
_ROWS = pa.schema([("file", pa.string()), ("row", pa.int64()), ("values", pa.list_(pa.float64())), ("error", pa.string())])


@dataclass
class Array:
    """An array of an npz file: rows, numbers in a row, type, bytes of its header, and where it begins, if it is stored as it is."""

    rows: int
    width: int
    dtype: np.dtype
    head: int
    offset: int | None


def _array(f, name: str) -> Array:
    with zipfile.ZipFile(f) as z:
        info = z.getinfo(f"{name}.npy")
        with z.open(info) as m:
            version = np.lib.format.read_magic(m)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
            head = m.tell()
    if fortran or dtype.hasobject or not shape:
        raise ValueError(f"{name}: rows of an array in order of rows are needed")
    offset = None
    if info.compress_type == zipfile.ZIP_STORED:
        f.seek(info.header_offset + 26)
        sizes = np.frombuffer(f.read(4), "<u2")
        offset = info.header_offset + 30 + int(sizes.sum()) + head
    return Array(shape[0], int(np.prod(shape[1:], dtype=np.int64)), dtype, head, offset)


def npz_ranges(path: str, name: str = "arr_0", chunk: int = CHUNK) -> Iterator[tuple[str, int, int]]:
    """path and ranges of rows; a compressed array is one range. An array that cannot be read is the range from -1."""
    try:
        with opened(path) as f:
            a = _array(f, name)
    except (ValueError, KeyError, OSError, zipfile.BadZipFile):
        yield path, -1, -1
        return
    step = max(1, chunk // max(1, a.width * a.dtype.itemsize)) if a.offset is not None else max(1, a.rows)
    for s in range(0, a.rows, step):
        yield path, s, min(s + step, a.rows)


def npz_read(path: str, start: int, stop: int, name: str = "arr_0", batch: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows of a range, flattened, in batches of rows; the last may be shorter. Compressed rows are unpacked as they pass."""
    row = start
    try:
        with opened(path) as f:
            a = _array(f, name)
            f.seek(0)
            width = a.width * a.dtype.itemsize
            if a.offset is None:
                source = zipfile.ZipFile(f).open(f"{name}.npy")
                source.read(a.head)
            else:
                f.seek(a.offset + start * width)
                source = f
            while row < stop:
                n = min(batch, stop - row)
                raw = source.read(n * width)
                if len(raw) < n * width:
                    raise OSError(f"{name}: {row + len(raw) // max(1, width)} of {a.rows} rows")
                values = np.frombuffer(raw, a.dtype).reshape(n, a.width).astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.width), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(row, row + n)), lists, pa.nulls(n, pa.string())], schema=_ROWS)
                row += n
    except (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile, zipfile.error) as e:
        yield pa.RecordBatch.from_pylist([{"file": path, "row": None, "values": None, "error": str(e)[:200]}], _ROWS)


def _dealt(spark: SparkSession, path: str, plan: Callable, read: Callable, schema: str) -> DataFrame:
    """What read gives of each range that plan cuts the files into."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                found = list(plan(p))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "start", "stop"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, start, stop in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield from read(p, start, stop)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.read.format("binaryFile").load(path).select("path")  # names only: no content is read
    return listed.repartition(tasks, "path").mapInArrow(planned, RANGE).repartition(tasks).mapInArrow(unpacked, schema)


def tar_samples(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """__key__, __url__, parts (extension -> bytes) and error of the samples in tar shards."""
    rows = _dealt(spark, path, lambda p: tar_ranges(p, chunk), tar_read, SAMPLE)
    return rows.withColumn("parts", F.map_from_entries("parts"))


def npz_rows(spark: SparkSession, path: str, name: str = "arr_0", batch: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """file, row, values and error of the rows of an array in npz files."""
    return _dealt(spark, path, lambda p: npz_ranges(p, name, chunk), lambda p, a, b: npz_read(p, a, b, name, batch), ROWS)


def listed(path: str) -> list[str]:
    """Files below a folder, or that match a pattern in the last part of the path."""
    store, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    top, _, last = inner.rpartition("/")
    if store.get_file_info(inner).type == pafs.FileType.Directory:
        top, last = inner, "*"
    scheme = path.partition("://")[0] + "://" if "://" in path else "file://"
    found = [i for i in store.get_file_info(pafs.FileSelector(top)) if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, last) and not i.base_name.startswith((".", "_"))]
    return sorted(f"{scheme}{i.path}" for i in found)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    stop: int


class RangeReader(DataSourceReader):
    """A partition a range of each file."""

    def __init__(self, options: dict[str, str], plan: Callable, read: Callable):
        self.options, self.plan, self.unpack = options, plan, read

    def partitions(self) -> list[Part]:
        return [Part(*r) for p in listed(self.options["path"]) for r in self.plan(p, int(self.options.get("chunk", CHUNK)))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # there may be no files
            yield from self.unpack(partition.path, partition.start, partition.stop)


class TarSource(DataSource):
    """spark.read.format("tessera_tar").load(path): samples of tar shards; option chunk (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tar"

    def schema(self) -> str:
        return SAMPLE

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options, tar_ranges, tar_read)


class NpzSource(DataSource):
    """spark.read.format("tessera_npz").load(path): rows of an array; options array, batch (rows), chunk (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_npz"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> RangeReader:
        name, batch = self.options.get("array", "arr_0"), int(self.options.get("batch", 1024))
        return RangeReader(self.options, lambda p, chunk: npz_ranges(p, name, chunk), lambda p, a, b: npz_read(p, a, b, name, batch))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)
    spark.dataSource.register(NpzSource)
