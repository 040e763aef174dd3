"""Removal of near-duplicate lines by an exact set-similarity join.

A line's set is its distinct lower-cased (ASCII) words. Tokens are ordered by rarity: by their count in the corpus, kept
on a logarithmic scale in a hashed table of fixed size, then by hash. Any common order makes the join exact; the rarer the
first tokens, the fewer candidates. Of two lines with a Jaccard similarity of at least `threshold` percent, the longer's
first n - ceil(t n) + 1 tokens and the shorter's first n - ceil(2 t n / (1 + t)) + 1 share one; candidates must also pass
the length filter, the positional filter and a bound by 64 parities of token hashes (which differ at most in as many places
as the sets have tokens apart), and are verified on their whole sets. A line goes if any line before it, by
(doc_id, row, line number), matches it, kept or not. Rows are told apart by a number that a stored table gives them as they
are read, so rows without an id (which come first) or with the same id lose only lines of their own.

Prefix rows are packed by the task that makes them, a block for each part of the tokens, so that shuffles move few rows of
dense bytes; the number of parts follows from the number of prefix rows, which bounds a part's memory. Tokens that are very
frequent in the corpus are dealt by bands of set sizes besides: sets that match lie in the same band or in neighbouring ones.
Within a token, sets sorted by size meet those of the sizes that can match.

One earlier match is enough. So a set first meets the FIRST candidates before it of each of its prefix tokens; only sets that
may have more and found no match meet all the others. In a group of thousands of near copies nearly all are settled at once.
Candidates are compared by SIGNATURE parities before whole sets are, and of what is left the closest candidate comes first.

Lines without words always stay, as do those with fewer than `least` distinct words, where more than
one are asked for. A set too small to match any but an equal one needs no prefix: copies are found by the sets' hashes. Null texts stay
null, empty ones empty; a document whose lines all go keeps its row with an empty text. Words are told apart by 44 bits of
their hash, sets by 64, in the verified similarity, too: it is exact up to collisions of these. Sets are not carried through shuffles: the lines that are compared are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Words, column, mixed, positional, stored, text_bytes

BITS = 22
SEGMENT = 1 << 16
#: Candidates of a token that are tried at first.
FIRST = 16
#: Parities that candidates are compared by before their sets are.
SIGNATURE = 512
#: Bits of the tables that tell which sets, rows or lines are wanted: exact tests follow.
WANTED_BITS = 24
#: Names a row of the stored table.
ROW = "__row"
#: Lines that are sorted at once: their number and a token fill 64 bits.
LINES = 1 << 12
HASH = 44
#: Prefix rows of a part, and those that a task packs at once.
PART_ROWS, PACKED_ROWS = 400_000, 300_000
#: From this count on (in the corpus) a token's sets are dealt by bands of sizes.
FREQUENT = 1 << 18
#: Up to so many sets, a token's sets meet all of the sizes that can match; beyond, each looks back until it has enough.
WINDOW = 4096
#: How a set stands in the group of a token: with all others, in its band, or in the next band.
WHOLE, RESIDENT, VISITOR = 0, 1, 2
_LOW = np.uint64((1 << HASH) - 1)
#: What is kept of each prefix token.
_FIELDS = [("token", "<i4"), ("cls", "<i8"), ("parity", "<i8"), ("n", "<i4"), ("at", "<i4"), ("band", "<i1"), ("doc", "<i8"), ("row", "<i8"), ("line", "<i4")]


def _batches(b: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of about a million bytes."""
    sizes = np.array(pa.compute.binary_length(column(b, text_col)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(sizes) // 1_000_000
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e > s:
            yield b.slice(s, e - s)


def index_length(n: np.ndarray, threshold: int) -> np.ndarray:
    """The prefix that the shorter set of a pair needs."""
    return n - -(-2 * threshold * n // (100 + threshold)) + 1


def prefix_length(n: np.ndarray, threshold: int) -> np.ndarray:
    return n - -(-threshold * n // 100) + 1


def _flat(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, ... sizes[i] of them, for all i."""
    return np.repeat(at - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(at) else np.zeros(0, np.int64)


class LineSets:
    """Distinct tokens of each line with a word in a batch of texts, the rarest first: lines by (doc, line), tokens flat.

    A token is its rank (8 bits, 0 without ranks) and HASH bits of its word's hash."""

    def __init__(self, texts: pa.Array, ranks: np.ndarray | None):
        w = Words(texts, lower=True)
        h = w.hashes()
        self.hashes = h
        ends = np.flatnonzero(w.body == 10)
        cuts = np.concatenate([[0], np.searchsorted(w.starts, ends), [len(h)]])
        line = np.repeat(np.arange(len(ends) + 1), np.diff(cuts))  # line ends before the word, over all texts
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])  # a text's end ends a line too
        begin = np.flatnonzero(fresh)
        self.doc = doc[begin]
        self.line = line[begin] - np.searchsorted(ends, w.offsets[:-1])[self.doc]
        word = h >> np.uint64(64 - HASH)
        if ranks is not None:
            word |= ranks[h >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(HASH)
        place = np.cumsum(fresh) - 1
        tokens, sizes = [], []
        for lo in range(0, len(begin), LINES):
            s, e = begin[lo], begin[lo + LINES] if lo + LINES < len(begin) else len(h)
            key = (place[s:e] - lo).astype(np.uint64) << np.uint64(HASH + 8) | word[s:e]
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            tokens.append(key & np.uint64((1 << (HASH + 8)) - 1))
            sizes.append(np.bincount((key >> np.uint64(HASH + 8)).astype(np.int64)))
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.at = np.cumsum(self.n) - self.n

    def classes(self) -> np.ndarray:
        x = (self.tokens & _LOW) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return mixed(np.add.reduceat(x * np.uint64(0xBF58476D1CE4E5B9), self.at)).view(np.int64) if len(self.n) else np.zeros(0, np.int64)


class Batch:
    """The lines of a batch that take part: ids, places, sets and their hashes."""

    def __init__(self, part: pa.RecordBatch, ranks: np.ndarray | None, least: int, id_col: str, text_col: str):
        s = LineSets(column(part, text_col), ranks)
        big = s.n >= least
        # null ids come first; that -2**63 may be an id is no matter, as rows are told apart by their own numbers
        ids = np.array(column(part, id_col).cast(pa.int64()).fill_null(-(2**63)).to_numpy())
        self.doc, self.row = ids[s.doc[big]], column(part, ROW).to_numpy()[s.doc[big]]
        self.line, self.cls, self.n, self.at, self.tokens, self.hashes = s.line[big], s.classes()[big], s.n[big], s.at[big], s.tokens, s.hashes

    def firsts(self) -> np.ndarray:
        """Of each set in the batch its first line by (doc, row, line)."""
        order = np.lexsort((self.line, self.row, self.doc, self.cls))
        return order[np.concatenate([[True], self.cls[order][1:] != self.cls[order][:-1]])] if len(order) else order


LINE_ROWS = "doc_id long, row long, line long, cls long, prefix long, segment int, at binary, count binary"


def _line_rows(threshold: int, least: int, id_col: str, text_col: str):
    """A row for each line, and the counts of the task's tokens by segments of the hashed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(1 << BITS, np.int64), [], 0
        for b in batches:
            for part in _batches(b, text_col):
                x = Batch(part, None, least, id_col, text_col)
                held.append((x.hashes >> np.uint64(64 - BITS)).astype(np.int32))
                waiting += len(x.hashes)
                if waiting >= 1 << BITS:  # the table is long: it is not walked for each batch
                    total += np.bincount(np.concatenate(held), minlength=1 << BITS)
                    held, waiting = [], 0
                none = [pa.nulls(len(x.n), t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(x.doc), pa.array(x.row), pa.array(x.line), pa.array(x.cls), pa.array(_prefix_sizes(x.n, threshold)), *none], names=["doc_id", "row", "line", "cls", "prefix", "segment", "at", "count"])
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << BITS)
        for s in range(0, 1 << BITS, SEGMENT):
            part = total[s : s + SEGMENT]
            at = np.flatnonzero(part)
            if len(at):
                none = [pa.nulls(1, pa.int64())] * 5
                own = [pa.array([s // SEGMENT], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([part[at].astype("<i8").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *own], names=["doc_id", "row", "line", "cls", "prefix", "segment", "at", "count"])

    return run


def token_ranks(counts: DataFrame) -> np.ndarray:
    """For each hash bucket its tokens' count on a logarithmic scale: 1 for a single one, at most 255."""

    def add(table):
        total = np.zeros(SEGMENT, np.int64)
        for a, n in zip(table.column("at").to_pylist(), table.column("count").to_pylist(), strict=True):
            total[np.frombuffer(a, "<u2")] += np.frombuffer(n, "<i8")
        rank = np.where(total > 0, 1 + np.minimum(254, np.ceil(8 * np.log2(np.maximum(total, 1)))), 1).astype(np.uint8)
        return pa.table({"segment": table.column("segment")[:1], "rank": pa.array([rank.tobytes()], pa.binary())})

    rows = counts.select("segment", "at", "count").groupBy("segment").applyInArrow(add, "segment int, rank binary").collect()
    out = np.ones(1 << BITS, np.uint8)
    for r in rows:  # one byte a bucket
        out[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(r["rank"], np.uint8)
    return out


def _prefix_sizes(n: np.ndarray, threshold: int) -> np.ndarray:
    """Of n words, the closest other set has n + 1."""
    return np.where(100 * n >= threshold * (n + 1), prefix_length(n, threshold), 0)


def _parities(x: Batch, k: np.ndarray) -> np.ndarray:
    """For 64 classes of token hashes, whether the set has an odd number of them."""
    sizes = x.n[k]
    bit = np.uint64(1) << (x.tokens[_flat(x.at[k], sizes)] & np.uint64(63))
    return np.bitwise_xor.reduceat(bit, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(k) else np.zeros(0, np.uint64)


def _band(n: np.ndarray, threshold: int) -> np.ndarray:
    """Sets that match lie in one band or in two that follow each other."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / threshold) + 1e-9).astype(np.int64) if threshold < 100 else n


def _pack(fields: list[np.ndarray]) -> bytes:
    """The fields' bytes, all first bytes, then all second ones and so on: what is alike stands together."""
    planes = [np.ascontiguousarray(f.astype(t, copy=False).view(np.uint8).reshape(len(f), -1).T) for f, (_, t) in zip(fields, _FIELDS, strict=True)]
    raw = b"".join(p.tobytes() for p in planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    widths = [np.dtype(t).itemsize for _, t in _FIELDS]
    n, at, out = size // sum(widths), 0, []
    for w, (_, t) in zip(widths, _FIELDS, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def _prefix_fields(x: Batch, threshold: int, frequent: int, tokens) -> list[np.ndarray]:
    """Prefix tokens that may occur elsewhere, once a set. 32 bits of a token bring together what must meet; what they bring
    together besides is told apart later. tokens: a table of the (short) tokens that are asked for, else all."""
    k = x.firsts()
    parity = np.zeros(len(x.n), np.uint64)
    parity[k] = _parities(x, k)
    take = _prefix_sizes(x.n[k], threshold)
    owner, flat = np.repeat(k, take), _flat(x.at[k], take)
    token = x.tokens[flat]
    rank = token >> np.uint64(HASH)
    keep = rank > 1
    short = (token >> np.uint64(8)).astype(np.uint32).view(np.int32)
    if tokens is not None:
        keep &= _has(tokens, short.astype(np.int64))
    owner, flat, short, rank = owner[keep], flat[keep], short[keep], rank[keep]
    own = [short, x.cls[owner], parity[owner].view(np.int64), x.n[owner], flat - x.at[owner], np.full(len(owner), WHOLE, np.int8), x.doc[owner], x.row[owner], x.line[owner]]
    band = np.full(len(owner), -1)
    often = np.flatnonzero(rank > 8 * np.log2(frequent))
    if len(often):  # these visit the next band, too
        own[5][often] = RESIDENT
        band[often] = _band(own[3][often], threshold)
        own = [np.concatenate([f, f[often]]) for f in own]
        own[5][len(owner) :] = VISITOR
        band = np.concatenate([band, band[often] + 1])
    return [*own, mixed(own[0].astype(np.uint64) << np.uint64(20) ^ (band + 1).astype(np.uint64))]


def _prefix_blocks(ranks, threshold: int, least: int, id_col: str, text_col: str, parts: int, tokens=None):
    frequent = FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            *fields, where = [np.concatenate(f) for f in zip(*held, strict=True)]
            part = (where % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            fields, part = [f[order] for f in fields], part[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
            blobs = [_pack([f[s:e] for f in fields]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for b in batches:
            for piece in _batches(b, text_col):
                fields = _prefix_fields(Batch(piece, ranks.value, least, id_col, text_col), threshold, frequent, None if tokens is None else tokens.value)
                if len(fields[0]):
                    held.append(fields)
                if sum(len(f[0]) for f in held) >= PACKED_ROWS:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return run


def _has(bits: np.ndarray, cls: np.ndarray) -> np.ndarray:
    at = cls & ((1 << WANTED_BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bit_table(cls: DataFrame) -> np.ndarray:
    """A table of WANTED_BITS bits in which each cls has its bit: 2 MB, whatever the input."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seg, places in zip(column(b, "seg").to_pylist(), column(b, "places").to_pylist(), strict=True):
                bits = np.zeros(SEGMENT, np.uint8)
                bits[places] = 1
                yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["seg", "bits"])

    bit = cls.select(F.col("cls").bitwiseAND(F.lit((1 << WANTED_BITS) - 1)).alias("bit"))
    rows = bit.groupBy(F.shiftright("bit", 16).alias("seg")).agg(F.collect_set(F.col("bit").bitwiseAND(F.lit(SEGMENT - 1))).alias("places")).mapInArrow(pack, "seg long, bits binary").collect()
    out = np.zeros(1 << WANTED_BITS >> 3, np.uint8)
    for r in rows:
        out[r["seg"] * SEGMENT // 8 : (r["seg"] + 1) * SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


class _Sets:
    """The prefix rows of a part: each set once a group (token and band), sorted by group, then by size or by order."""

    def __init__(self, blobs: list[bytes], threshold: int, window: int):
        token, cls, parity, n, at, stands, doc, row, line = (np.concatenate(f) for f in zip(*map(_unpack, blobs), strict=True))
        self.threshold = threshold
        rows, place = np.unique(row, return_inverse=True)
        ids = np.zeros(len(rows), np.int64)
        ids[place] = doc
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((rows, ids))] = np.arange(len(rows))
        order = rank[place] << 32 | line  # (doc, row, line) in one number
        band = np.where(stands == WHOLE, -1, _band(n, threshold) + (stands == VISITOR))
        k = np.argsort(mixed(cls.view(np.uint64) + ((token.astype(np.uint64) << np.uint64(9)) + (band + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)))
        fresh = np.concatenate([[True], (token[k][1:] != token[k][:-1]) | (band[k][1:] != band[k][:-1]) | (cls[k][1:] != cls[k][:-1])])
        run = np.cumsum(fresh) - 1
        again = np.flatnonzero(np.bincount(run)[run] > 1)  # these stand by order within their run
        k[again] = k[again[np.lexsort((order[k[again]], run[again]))]]
        k = k[fresh]  # a set once a group, with its first line
        k = k[np.argsort(token[k].astype(np.int64) << 10 | band[k] + 1)]
        self.token, self.band, self.cls, self.parity, self.n, self.at, self.visitor, self.order = token[k], band[k], cls[k], parity[k].view(np.uint64), n[k].astype(np.int64), at[k].astype(np.int64), stands[k] == VISITOR, order[k]
        fresh = np.concatenate([[True], (self.token[1:] != self.token[:-1]) | (self.band[1:] != self.band[:-1])])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(k)))
        self.group = np.repeat(np.arange(len(begin)), size)
        self.wide = (size > window)[self.group]

    def candidates(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs i, j pass all filters, and in how many parities they differ."""
        n, at, t = self.n, self.at, self.threshold
        apart = np.bitwise_count(self.parity[i] ^ self.parity[j]).astype(np.int64)
        both = n[i] + n[j]
        near = np.flatnonzero((100 + t) * apart <= (100 - t) * both)
        i, j, both = i[near], j[near], both[near]
        short = np.minimum(n[i], n[j])
        first, last = np.where(n[i] <= n[j], at[i], at[j]), np.where(n[i] <= n[j], at[j], at[i])
        # equal sizes may stand either way round; two visitors meet in the band that they come from
        ok = (first < index_length(short, t)) | ((n[i] == n[j]) & (last < index_length(short, t)))
        ok &= (100 * short >= t * (both - short)) & ((100 + t) * np.minimum(n[i] - at[i], n[j] - at[j]) >= t * both)
        ok &= ~(self.visitor[i] & self.visitor[j])
        return near[ok], apart[near[ok]]

    def by_size(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """later, earlier, parities apart: all candidate pairs of the small groups."""
        k = np.flatnonzero(~self.wide)
        k = k[np.argsort(self.group[k] << 32 | self.n[k])]
        n, group = self.n[k], self.group[k]
        # of each set, how far back the sizes go that can match
        least = -(-self.threshold * n // 100)
        key = group << 32 | n
        back = np.arange(len(k)) - np.searchsorted(key, group << 32 | least)
        found, step, live = [], 1, np.flatnonzero(back >= 1)
        while len(live):
            i, j = k[live - step], k[live]
            hit, apart = self.candidates(i, j)
            i, j = i[hit], j[hit]
            swap = self.order[i] > self.order[j]
            found.append((np.where(swap, i, j), np.where(swap, j, i), apart))
            step += 1
            live = live[back[live] >= step]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def by_order(self, enough: int, probes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the large groups, where each set looks back until it has more than enough; with probes, these look at all."""
        k = np.flatnonzero(self.wide)
        k = k[np.lexsort((self.order[k], self.group[k]))]
        before = np.arange(len(k)) - np.searchsorted(self.group[k], self.group[k])
        met, found, step = np.zeros(len(k), np.int64), [], 1
        live = np.flatnonzero(before > 0)
        if probes is not None:
            live = live[_has(probes, self.cls[k[live]])]
        while len(live):
            hit, apart = self.candidates(k[live - step], k[live])
            found.append((k[live[hit]], k[live[hit] - step], apart))
            met[live[hit]] += 1
            step += 1
            live = live[(before[live] >= step) & ((met[live] <= enough) if probes is None else True)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


PAIR_ROWS = "later long, earlier long, apart int, token int"


def _token_pairs(threshold: int, probes=None):
    """Candidate pairs of the sets of each token. Without probes each set meets FIRST candidates before it, the closest by their
    parities, and a row (later, null, null, token) says that there may be more; with probes only these meet all."""

    first, window = FIRST, WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in column(b, "blob").to_pylist()]
        if not blobs:
            return
        sets = _Sets(blobs, threshold, window)
        bits = None if probes is None else probes.value
        found = [np.concatenate(x) for x in zip(sets.by_size(), sets.by_order(first, bits), strict=True)]
        later, earlier, apart = found
        if bits is not None:
            k = np.flatnonzero(_has(bits, sets.cls[later]))
            more = np.zeros(0, np.int64)
        else:
            order = np.lexsort((sets.order[earlier], apart, later))
            place = np.arange(len(order)) - np.searchsorted(later[order], later[order])
            k = order[place < first]
            more = np.unique(later[order[place >= first]])
        out = [np.concatenate([sets.cls[later[k]], sets.cls[more]]), np.concatenate([sets.cls[earlier[k]], sets.cls[more]]), np.concatenate([apart[k], more]).astype(np.int32)]
        pair = np.arange(len(out[0])) < len(k)
        token = np.concatenate([sets.token[later[k]], sets.token[more]])
        arrays = [pa.array(out[0]), pa.array(out[1], mask=~pair), pa.array(out[2], mask=~pair), pa.array(token, pa.int32(), mask=pair)]
        table = pa.Table.from_arrays(arrays, names=["later", "earlier", "apart", "token"])
        yield from table.to_batches(max_chunksize=50_000)

    return run


def _spot(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mixed(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64)) >> np.uint64(8)).view(np.int64)


def _signatures(s: LineSets) -> list[bytes]:
    """Of each set, for SIGNATURE classes of token hashes, whether it has an odd number of them."""
    cell = np.repeat(np.arange(len(s.n)) * SIGNATURE, s.n) + ((s.tokens >> np.uint64(6)) & np.uint64(SIGNATURE - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(s.n) * SIGNATURE) & 1).astype(np.uint8).reshape(-1, SIGNATURE)
    return [x.tobytes() for x in np.packbits(odd, axis=1)]


def _wanted_sets(rows, spots, text_col: str):
    """cls, size, signature and sorted token hashes (6 bytes each) of the lines that are asked for by tables of their rows and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_has(rows.value, column(b, ROW).to_numpy())))
            for part in _batches(b, text_col) if b.num_rows else ():
                body, offsets = text_bytes(column(part, text_col))
                ends = np.flatnonzero(body == 10)
                begin = np.sort(np.concatenate([offsets[:-1], ends + 1]))
                begin = begin[np.concatenate([[True], begin[1:] != begin[:-1]])] if len(begin) else begin
                begin = begin[begin < len(body)]
                doc = np.searchsorted(offsets, begin, side="right") - 1
                line = np.searchsorted(ends, begin) - np.searchsorted(ends, offsets[:-1])[doc]
                stop = np.append(begin[1:], len(body))
                want = np.flatnonzero(_has(spots.value, _spot(column(part, ROW).to_numpy()[doc], line)))
                view = memoryview(body)
                for lo in range(0, len(want), LINES):
                    some = want[lo : lo + LINES].tolist()
                    texts = pa.array([bytes(view[begin[x] : stop[x]]).replace(b"\n", b"") for x in some], pa.large_binary()).cast(pa.large_string())
                    s = LineSets(texts, None)
                    packed = np.ascontiguousarray(s.tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                    lists = [packed[6 * a : 6 * (a + n)] for a, n in zip(s.at.tolist(), s.n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.classes()), pa.array(s.n, pa.int32()), pa.array(_signatures(s), pa.binary()), pa.array(lists, pa.binary())], names=["cls", "n", "sig", "tokens"])

    return run


def _wide(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of packed sets, one after another, and the sets' sizes."""
    raw = np.frombuffer(b"".join(lists.to_pylist()), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel(), np.array(pa.compute.binary_length(lists).to_numpy(zero_copy_only=False), np.int64) // 6


def _near(threshold: int):
    """The pairs whose signatures allow that they match, and in how many parities these differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t, u = (np.frombuffer(b"".join(column(b, c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("t", "u"))
                apart = np.bitwise_count(t ^ u).sum(1, dtype=np.int64)
                both = column(b, "n").to_numpy().astype(np.int64) + column(b, "m").to_numpy()
                keep = pa.array((100 + threshold) * apart <= (100 - threshold) * both)
                yield pa.RecordBatch.from_arrays([column(b, "later"), column(b, "earlier"), pa.array(apart)], names=["later", "earlier", "apart"]).filter(keep)

    return run


def _asked(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_has(wanted.value, column(b, "cls").to_numpy())))

    return run


def _confirmed(threshold: int):
    """cls of the later sets of the pairs whose whole sets are as close as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, LINES):
                part = b.slice(lo, LINES)
                (t, n), (u, m) = _wide(column(part, "t")), _wide(column(part, "u"))
                pair = np.arange(part.num_rows, dtype=np.uint64) << np.uint64(HASH)
                key = np.concatenate([np.repeat(pair, n) | t, np.repeat(pair, m) | u])
                key.sort()
                common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(HASH)).astype(np.int64), minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([column(part, "later").filter(pa.array((100 + threshold) * common >= threshold * (n + m)))], names=["cls"])

    return run


def removals(docs: DataFrame, threshold: int = 80, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ROW, lines (sorted numbers from 0) of the rows that lose lines. docs: a stored table with a column ROW."""
    spark = docs.sparkSession
    docs = docs.select(id_col, ROW, text_col)
    made = stored(docs.mapInArrow(_line_rows(threshold, least, id_col, text_col), LINE_ROWS), "lines")
    ranks = spark.sparkContext.broadcast(token_ranks(made.where("segment is not null")))
    # a very common line is dealt into 64 groups
    lines = made.where("segment is null").select("doc_id", "row", "line", "cls", F.pmod(F.xxhash64("row"), F.lit(64)).cast("int").alias("salt")).repartition("cls", "salt")
    salted = lines.groupBy("cls", "salt").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("copies"))
    firsts = stored(salted.groupBy("cls").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"), F.collect_list("salt").alias("salts")), "line-sets")
    rows = made.agg(F.coalesce(F.sum("prefix"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))

    def candidates(probes=None, tokens=None) -> DataFrame:
        blocks = docs.mapInArrow(_prefix_blocks(ranks, threshold, least, id_col, text_col, parts, tokens), "part int, blob binary")
        return stored(blocks.repartitionById(parts, F.col("part")).mapInArrow(_token_pairs(threshold, probes), PAIR_ROWS), "line-pairs")

    def table(cls: DataFrame):
        return spark.sparkContext.broadcast(_bit_table(cls))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("later", "earlier")).alias("cls"))

    def both(pairs: DataFrame, sets: DataFrame, **of: tuple[str, str]) -> DataFrame:
        """The pairs with columns of the earlier set and of the later one."""
        for k, end in enumerate(("earlier", "later")):
            pairs = pairs.join(sets.select(F.col("cls").alias(end), *[F.col(c).alias(names[k]) for c, names in of.items()]), end)
        return pairs

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        asked = sets.select("cls", "tokens").mapInArrow(_asked(table(ends(pairs))), "cls long, tokens binary")
        return stored(both(pairs.select("later", "earlier"), asked, tokens=("t", "u")).select("later", "t", "u").mapInArrow(_confirmed(threshold), "cls long").distinct(), "later-sets")

    def matched(pairs: DataFrame) -> DataFrame:
        """cls of the later sets that one of their pairs confirms. pairs: later, earlier."""
        pairs = stored(pairs.distinct(), "line-pairs")
        places = stored(firsts.select("cls", "first.row", "first.line").join(ends(pairs).distinct(), "cls", "left_semi").mapInArrow(_places, "cls long, row long, spot long"), "wanted")
        rows, spots = (table(places.select(F.col(c).alias("cls"))) for c in ("row", "spot"))
        sets = stored(docs.mapInArrow(_wanted_sets(rows, spots, text_col), "cls long, n int, sig binary, tokens binary"), "sets")
        near = both(pairs, sets, n=("n", "m"), sig=("t", "u")).mapInArrow(_near(threshold), "later long, earlier long, apart long")
        near = stored(near, "near-pairs")
        best = stored(near.groupBy("later").agg(F.min_by("earlier", F.struct("apart", "earlier")).alias("earlier")), "best-pairs")
        later = confirmed(best, sets)
        others = stored(near.join(later.withColumnRenamed("cls", "later"), "later", "left_anti").join(best, ["later", "earlier"], "left_anti"), "other-pairs")
        return later.unionByName(confirmed(others, sets)) if others.limit(1).count() else later

    found = candidates()
    later = matched(found.where("earlier is not null").select("later", "earlier"))
    unsettled = stored(found.where("earlier is null").select(F.col("later").alias("cls"), "token").join(later, "cls", "left_anti"), "unsettled")
    if unsettled.limit(1).count():
        # only the tokens at which these sets have more are read again; what shares a bit with them does no harm
        probes, tokens = (table(unsettled.select(F.col(c).cast("long").alias("cls"))) for c in ("cls", "token"))
        later = later.unionByName(matched(candidates(probes, tokens).select("later", "earlier")))
    later = later.distinct().withColumn("later", F.lit(True))
    losing = firsts.join(later, "cls", "left").where((F.col("copies") > 1) | F.col("later"))
    losing = losing.select("cls", F.explode("salts").alias("salt"), "first", F.coalesce("later", F.lit(False)).alias("later"))
    gone = lines.join(losing, ["cls", "salt"]).where(F.col("later") | (F.struct("doc_id", "row", "line") != F.col("first")))
    return gone.groupBy(F.col("row").alias(ROW)).agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spot = _spot(column(b, "row").to_numpy(), column(b, "line").to_numpy())
        yield pa.RecordBatch.from_arrays([column(b, "cls"), column(b, "row"), pa.array(spot)], names=["cls", "row", "spot"])


def deduplicated(docs: DataFrame, threshold: int = 80, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines removed from its text; all columns, whatever their names, and rows stay."""
    plain, (id_at, text_at) = positional(docs, id_col, text_col)
    keyed = stored(plain.withColumn(ROW, F.monotonically_increasing_id()), "line-rows")
    gone = removals(keyed, threshold, least, id_at, text_at).withColumnRenamed("lines", "gone")
    joined = keyed.join(gone.hint("shuffle_hash"), ROW, "left")
    names = list(docs.columns)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = column(b, "gone")
            texts = b.column(at)
            if gone.null_count < len(gone):
                new = texts.to_pylist()
                for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    if new[k] is not None:
                        drop = set(gone[k].as_py())
                        new[k] = "\n".join([x for i, x in enumerate(new[k].split("\n")) if i not in drop])
                texts = pa.array(new, texts.type)
            cols = list(b.columns[: len(names)])
            cols[at] = texts
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select(*plain.columns, "gone").mapInArrow(run, docs.schema)
