"""Packing documents into sequences of a fixed number of tokens by a linear grouping scheme.

Only pieces shorter than a sequence need packing, and they have fewer distinct lengths than a sequence has tokens. So the
plan is made on the driver from their histogram, whose size does not follow the input, and the documents are then
assigned by their rank among those of equal length:

1. lengths over `small` are sorted and dealt into groups of equal cardinality; each is rounded up to its group's largest;
2. configurations of these few sizes are chosen one after another, each the fullest that holds the largest size left
   (bounded subset sums), and used as often as the counts allow;
3. actual documents replace the rounded sizes; runs of sequences with the same actual lengths stay one entry of the plan;
4. what is then free is filled by best fit: longest first, each into the fullest sequences that can hold it.

Null and empty texts are a document of the end id alone. Repeated ids are repeated documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import column, stored
from tessera.llm.tokens import encoder

#: A run of the plan: items of one length with ranks first..first+n-1 go `each` to a sequence from `sequence` on, from `offset` on.
RUN = np.dtype([("length", "i8"), ("first", "i8"), ("n", "i8"), ("sequence", "i8"), ("each", "i8"), ("offset", "i8")])


class _Plan:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        self.left = counts.astype(np.int64).copy()
        self.next = np.zeros(len(counts), np.int64)
        self.runs: list[tuple[int, ...]] = []
        self.sequences = 0
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int, sequences: int, first: int, each: int, offset: int) -> None:
        n = sequences * each
        self.runs.append((length, int(self.next[length]), n, first, each, offset))
        self.next[length] += n
        self.left[length] -= n


def _fullest(sizes: list[int], counts: list[int], capacity: int, lead: int) -> dict[int, int]:
    """Of the configurations that hold sizes[lead], the one with the largest sum within the capacity: size index -> copies."""
    room = capacity - sizes[lead]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by = np.full((room + 1, 2), -1, np.int64)
    for j in range(lead, len(sizes)):
        have = counts[j] - (j == lead)
        base = reach.copy()
        for k in range(1, min(have, room // sizes[j]) + 1):
            shifted = np.zeros_like(reach)
            shifted[k * sizes[j] :] = base[: room + 1 - k * sizes[j]]
            fresh = shifted & ~reach
            by[fresh] = (j, k)
            reach |= fresh
        if reach[room]:
            break
    total = int(np.flatnonzero(reach)[-1])
    used: dict[int, int] = {lead: 1}
    while total:
        j, k = (int(x) for x in by[total])
        used[j] = used.get(j, 0) + k
        total -= k * sizes[j]
    return used


def _place_large(plan: _Plan, small: int, groups: int) -> None:
    lengths = [x for x in range(plan.capacity - 1, small, -1) if plan.left[x]]
    total = int(sum(plan.left[x] for x in lengths))
    if not total:
        return
    per = -(-total // groups)
    queues: list[list[list[int]]] = [[]]
    room = per
    for x in lengths:
        n = int(plan.left[x])
        while n:
            if not room:
                queues.append([])
                room = per
            take = min(n, room)
            queues[-1].append([x, take])
            n, room = n - take, room - take
    sizes = [q[0][0] for q in queues]
    counts = [sum(n for _, n in q) for q in queues]
    lead = 0
    while lead < len(sizes):
        if not counts[lead]:
            lead += 1
            continue
        used = _fullest(sizes, counts, plan.capacity, lead)
        times = min(counts[j] // k for j, k in used.items())
        for j, k in used.items():
            counts[j] -= times * k
        while times:
            heads = {j: next(r for r in queues[j] if r[1]) for j in used}
            together = min([times, *(heads[j][1] // k for j, k in used.items())])
            n, offset = max(1, together), 0
            for j, k in used.items():
                need = k
                while need:
                    run = next(r for r in queues[j] if r[1])
                    each = need if together else min(need, run[1])
                    plan.put(run[0], n, plan.sequences, each, offset)
                    run[1] -= n * each
                    offset += each * run[0]
                    need -= each
                queues[j] = [r for r in queues[j] if r[1]]
            plan.free[plan.capacity - offset].append((plan.sequences, n))
            plan.sequences += n
            times -= n


def _fill(plan: _Plan, lengths: list[int]) -> None:
    """Best fit, longest first, into what is free, then into new sequences."""
    for x in lengths:
        for room in range(x, plan.capacity + 1):
            if not plan.left[x]:
                break
            each = room // x
            kept = []
            for first, n in plan.free[room]:
                full = min(n, int(plan.left[x]) // each)
                if full:
                    plan.put(x, full, first, each, plan.capacity - room)
                    plan.free[room - each * x].append((first, full))
                    first, n = first + full, n - full
                rest = min(each, int(plan.left[x]))
                if n and rest:
                    plan.put(x, 1, first, rest, plan.capacity - room)
                    plan.free[room - rest * x].append((first, 1))
                    first, n = first + 1, n - 1
                if n:
                    kept.append((first, n))
            plan.free[room] = kept
        if plan.left[x]:
            each = plan.capacity // x
            full, rest = divmod(int(plan.left[x]), each)
            if full:
                plan.put(x, full, plan.sequences, each, 0)
                plan.free[plan.capacity - each * x].append((plan.sequences, full))
                plan.sequences += full
            if rest:
                plan.put(x, 1, plan.sequences, rest, 0)
                plan.free[plan.capacity - rest * x].append((plan.sequences, 1))
                plan.sequences += 1


def packing_plan(counts: np.ndarray, capacity: int, small: int | None = None, groups: int = 1024) -> np.ndarray:
    """The runs for counts[length] items of each length up to the capacity, ordered by (length, first rank)."""
    plan = _Plan(counts, capacity)
    if n := int(plan.left[capacity]):
        plan.put(capacity, n, 0, 1, 0)
        plan.sequences += n
    small = 3 * capacity // 8 if small is None else small
    _place_large(plan, small, groups)
    _fill(plan, [x for x in range(small, 0, -1) if plan.left[x]])
    return np.sort(np.array(plan.runs, RUN), order=["length", "first"])


def token_pieces(docs: DataFrame, tokenizer: str, kind: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's task and rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        for b in batches:
            rows = []
            for doc, text in zip(column(b, id_col).to_pylist(), (x.as_py() for x in column(b, text_col)), strict=True):
                ids = np.append(enc(text), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long")


def assigned(pieces: DataFrame, capacity: int, groups: int = 1024) -> DataFrame:
    """pieces (of token_pieces, stored) with sequence_id and offset."""
    by_task = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length: at most `capacity`
        counts[r["length"]] = r["n"]
    plan = packing_plan(counts, capacity, groups=groups)
    shift = 2**44
    keys = plan["length"] * shift + plan["first"]
    sent = pieces.sparkSession.sparkContext.broadcast((plan, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, keys = sent.value
        for b in batches:
            length, rank = column(b, "length").to_numpy(), column(b, "rank").to_numpy()
            r = plan[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - r["first"]
            out = [column(b, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(r["sequence"] + nth // r["each"]), pa.array(r["offset"] + nth % r["each"] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by_task.select("task", "length", before.alias("before"))
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def packed(docs: DataFrame, tokenizer: str, kind: str = "words", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return assigned(stored(token_pieces(docs, tokenizer, kind, capacity, end_id), "pieces"), capacity)
