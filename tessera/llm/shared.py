"""What the operators of this package have in common: tables in the shared folder, and words of Arrow text as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space and \t \n \v \f \r.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on one machine (tests), a new temporary folder."""
    kept = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not kept:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        kept = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(kept)
    return kept.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, and a lost executor loses nothing.

    The caller's result may read these files later, so they stay; the folder is the cluster's to clean.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def positional(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1 and so on, which no working column is, and what the used ones are called there."""
    names = list(docs.columns)
    return docs.toDF(*[f"c{k}" for k in range(len(names))]), [f"c{names.index(u)}" for u in used]


def blank_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(BLANKS)] = True
    return table


_BLANK = blank_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd, so that its powers have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the n+1 offsets of the texts in them. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross any of the cuts (positions at which a new text begins)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    fresh = inside & ~before
    fresh[inner] = inside[inner]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = inside & ~after
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(fresh), np.flatnonzero(last) + 1


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the given byte spans: equal bytes give equal hashes, wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    block = 1 << 20
    first = 0
    while first < len(starts):  # blocks keep the tables of powers short
        stop = max(first + 1, int(np.searchsorted(starts, starts[first] + block)))
        lo, hi = int(starts[first]), int(ends[stop - 1])
        up, down = _power_tables(hi - lo + 1)
        part = body[lo:hi]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_MIX[_LOWER[part] if lower else part] * up[: hi - lo], out=sums[1:])
        s, e = starts[first:stop] - lo, ends[first:stop] - lo
        out[first:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        first = stop
    return mixed(out)


class Words:
    """Words (maximal runs of other bytes than the blanks) of a batch of texts: doc, start, end and hash of each."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.body, self.offsets = text_bytes(texts)
        self.starts, self.ends = runs(~_BLANK[self.body], self.offsets[:-1])
        self.first = np.searchsorted(self.starts, self.offsets)  # of each text, its first word; one more at the end
        self.lower = lower

    def hashes(self) -> np.ndarray:
        return span_hashes(self.body, self.starts, self.ends, self.lower)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that equal keys stay together: each result holds whole keys, as many as one batch ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = column(b, k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= column(held[-1], k)[-1].as_py() != v[0]
        cuts = np.flatnonzero(change)
        if len(cuts):
            if held or cuts[-1]:
                yield pa.Table.from_batches([*held, b.slice(0, int(cuts[-1]))]).combine_chunks().to_batches()[0]
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
