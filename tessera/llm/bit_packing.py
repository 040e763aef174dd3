"""Token ids in files of fixed-width bit packing.

A file holds the documents of one range of ids, in ascending order. Every token id takes the minimum number of bits for
the vocabulary. Layout, little-endian:

    8 bytes   b"BITPACK2"
    8 x int64 bits per id, ids a block, documents, ids, bytes before the block offsets, before the index, before the payload,
              documents without an id
    blocks    one int64 a block: where its packed bytes begin in the payload
    index     documents x (doc_id int64, ids before it in this file int64); those without an id come first, with 0
    payload   blocks of `ids a block` ids, each block begun on a byte

An id is read by looking up its block's offset and a shift, so any range unpacks with numpy without what precedes it.
Null and empty texts are a document that holds the end id alone; documents without an id come before all others, and
repeated or missing ids keep all their rows, in the order of their texts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import column, new_path
from tessera.llm.tokens import encoder

MAGIC = b"BITPACK2"
HEAD = 72
BLOCK = 4096
#: Characters of a text by which rows of one id are dealt out.
DEALT_BY = 64
#: Documents of a file are buffered as packed ids until it holds this many, then the next file begins.
FILE_IDS = 8_000_000


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids as consecutive groups of `bits` bits, the lowest first."""
    if len(ids) == 0:
        return np.zeros(0, np.uint8)
    if bits == 0:
        return np.zeros(0, np.uint8)
    words = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes
        return words[:, : bits // 8].reshape(-1)
    return np.packbits(np.unpackbits(words, axis=1, bitorder="little")[:, :bits].reshape(-1), bitorder="little")


def unpack(data: np.ndarray, first: int, n: int, bits: int) -> np.ndarray:
    """n ids that begin at the first-th of a packed block."""
    if n <= 0:
        return np.zeros(0, np.uint32)
    if bits % 8 == 0:  # whole bytes
        size = bits // 8
        words = np.zeros((n, 4), np.uint8)
        words[:, :size] = data[first * size : (first + n) * size].reshape(n, size)
        return words.view("<u4").reshape(-1)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.zeros(n, np.uint64)
    for k in range((bits + 7 + 7) // 8):
        wide |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((wide >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, nulls: int = 0) -> bytes:
    """nulls: of the first so many documents the ids are missing."""
    blocks = [pack(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    sizes = np.array([len(b) for b in blocks], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("<i8") if len(sizes) else np.zeros(0, "<i8")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("<i8") if len(lengths) else np.zeros(0, "<i8")
    index = np.stack([doc_ids.astype("<i8"), starts], axis=1) if len(doc_ids) else np.zeros((0, 2), "<i8")
    places = [HEAD, HEAD + 8 * len(offsets), HEAD + 8 * len(offsets) + 16 * len(doc_ids)]
    header = np.array([bits, BLOCK, len(doc_ids), len(ids), *places, nulls], "<i8")
    return b"".join([MAGIC, header.tobytes(), offsets.tobytes(), index.tobytes(), *[b.tobytes() for b in blocks]])


class BitFile:
    """A file image, read in place."""

    def __init__(self, image: bytes | pa.Buffer):
        data = np.frombuffer(image, np.uint8)
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a bit-packed token file")
        self.bits, self.block, self.n_docs, self.n_ids, a, b, c, self.nulls = (int(x) for x in data[8:HEAD].view("<i8"))
        self.offsets = data[a:b].view("<i8")
        index = data[b:c].view("<i8").reshape(-1, 2)
        self.doc_ids, self.starts = index[:, 0], index[:, 1]
        self.payload = data[c:]

    def read(self, first: int, n: int) -> np.ndarray:
        """Any n ids from the first-th on."""
        out = []
        while n > 0:
            k, inside = divmod(first, self.block)
            take = min(n, self.block - inside)
            end = int(self.offsets[k + 1]) if k + 1 < len(self.offsets) else len(self.payload)
            out.append(unpack(self.payload[int(self.offsets[k]) : end], inside, take, self.bits))
            first, n = first + take, n - take
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        end = int(self.starts[k + 1]) if k + 1 < self.n_docs else self.n_ids
        return self.read(int(self.starts[k]), end - int(self.starts[k]))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents under `folder` (a store that pyarrow.fs can open from executors). The manifest has a row a file:
    its path, its place in the order, documents, ids, and ids of all files before it.

    Documents are dealt out by ranges of their ids and texts' beginnings and encoded afterwards, so that only texts are shuffled. A file is
    written under a name of its own and renamed, so a repeated task leaves no half-written file in the manifest.
    """
    bits = max(1, int(vocabulary - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "spaces")
        store, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        count, made = 0, []

        def flush() -> None:
            nonlocal count
            if not doc_ids:
                return
            known = [x for x in doc_ids if x is not None]
            nulls = len(doc_ids) - len(known)  # they come first
            image = file_image(np.array([0] * nulls + known, np.int64), np.array([len(x) for x in held], np.int64), np.concatenate(held), bits, nulls)
            name = f"{root}/part-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.bits"
            with store.open_output_stream(f"{name}.tmp") as f:
                f.write(image)
            store.move(f"{name}.tmp", name)
            made.append((name, part, len(made), len(doc_ids), count, doc_ids[0]))
            held.clear()
            doc_ids.clear()
            count = 0

        store.create_dir(root, recursive=True)
        for b in batches:
            for doc, text in zip(column(b, id_col).to_pylist(), (x.as_py() for x in column(b, text_col)), strict=True):
                ids = np.append(enc(text), np.uint32(end_id)).astype(np.uint16 if bits <= 16 else np.uint32)
                held.append(ids)
                doc_ids.append(doc)
                count += len(ids)
                if count >= FILE_IDS:
                    flush()
        flush()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "part", "seq", "n_docs", "n_ids", "first_doc"), m, strict=True)) for m in made],
            schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64())]),
        )

    # one id may have very many rows, so their texts' beginnings deal them out too; null comes first
    dealt = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(F.col(id_col), F.substring(text_col, 1, DEALT_BY)).sortWithinPartitions(id_col, text_col)
    rows = dealt.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long, first_doc long").collect()  # a row a file
    before, manifest = 0, []
    for r in sorted(rows, key=lambda r: (r["part"], r["seq"])):
        manifest.append((*r, before))
        before += r["n_ids"]
    schema = "file string, part long, seq long, n_docs long, n_ids long, first_doc long, ids_before long"
    return docs.sparkSession.createDataFrame(manifest, schema)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, ids of all documents before it, count and crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, before in zip(column(b, "file").to_pylist(), column(b, "ids_before").to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    file = BitFile(f.read())
                ends = np.append(file.starts[1:], file.n_ids)
                crc = np.empty(file.n_docs, np.int64)
                at = 0
                while at < file.n_docs:  # documents of about a million ids together
                    to = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + 1_000_000)))
                    lo = int(file.starts[at])
                    ids = file.read(lo, int(ends[to - 1]) - lo).astype("<u4")
                    for k in range(at, to):
                        crc[k] = zlib.crc32(ids[int(file.starts[k]) - lo : int(ends[k]) - lo])
                    at = to
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, mask=np.arange(file.n_docs) < file.nulls), pa.array(file.starts + before), pa.array(ends - file.starts), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    spark = manifest.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 0) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "bitfiles")
    return read_token_files(write_token_files(docs, folder, tokenizer, vocabulary, end_id), folder)
