"""Sharding by virtual slots: records are hashed into a fixed number of slots, and a versioned map says which shard has a slot.

A record's slot is a hash of its id and never changes (records without an id are hashed by their text). Bytes are added up by
slot, and the map, one row a slot, is edited: full shards give up slots until none is above its share, largest first, and these
go to the emptiest shards; then single slots move, or are swapped, between the fullest and emptiest shard while that brings them
closer. All other slots stay where they are, so that only what moved has to be copied. Each edit is a new version, stored beside
the others; a reader of an earlier version still finds its map.

The law is `bytes`: shards have nearly equal sizes, up to what one slot holds. (What a record's shard will be with one more shard
thus depends on all sizes: rebalanced() with one more shard tells, and moves slots into that shard alone.)

Only slots, SLOTS of them, ever come to the driver. Places in a shard count through its slots: those of a slot's records are
counted within the slot, and begin where the slots before end.

Edge cases: null texts have no bytes and size 1; records that repeat an id share its slot, equal texts under several ids do not;
an empty table gives no rows and a map whose slots are dealt out in turn; one text of any length is in one shard, which may then
be larger than others; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, stored

SLOTS = 8192
#: Moves or swaps of single slots after the fullest shards gave up theirs.
STEPS = 4096
MAP = "version int, slot int, shard int, bytes long"


def slot_of(id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> Column:
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(1), F.coalesce(text_col, F.lit("")))).otherwise(F.xxhash64(F.lit(0), id_col))
    return F.pmod(key, F.lit(slots)).cast("int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(id_col, text_col, slots).alias("virtual_slot"))


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():  # a row a slot
        size[r.virtual_slot], rows[r.virtual_slot] = r["size"], r.n
    return size, rows


def in_turn(slots: int, shards: int) -> list[int]:
    """The first map: slots are dealt out in turn, whatever they hold."""
    return [k % shards for k in range(slots)]


def rebalanced(held: Sequence[int], sizes: Sequence[int], shards: int, steps: int = STEPS) -> list[int]:
    """The map held, edited for slots of these sizes and shards 0 to shards - 1. Slots of shards that are no more are dealt out."""
    out, share = list(held), sum(sizes) / shards
    own: list[list[int]] = [[] for _ in range(shards)]
    load, free = [0] * shards, []
    for k in sorted(range(len(out)), key=lambda k: (sizes[k], k)):
        if out[k] < shards:
            own[out[k]].append(k)
            load[out[k]] += sizes[k]
        else:
            free.append(k)
    for s in range(shards):  # the largest slots that fit into what is too much
        kept = []
        for k in reversed(own[s]):
            if sizes[k] and load[s] - sizes[k] >= share:
                load[s] -= sizes[k]
                free.append(k)
            else:
                kept.append(k)
        own[s] = kept
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for k in sorted(free, key=lambda k: (-sizes[k], k)):
        n, s = heapq.heappop(heap)
        out[k] = s
        own[s].append(k)
        load[s] = n + sizes[k]
        heapq.heappush(heap, (load[s], s))
    for _ in range(steps):
        full, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        best = _exchange(own[full], own[low], sizes, gap)
        if best is None:
            break
        a, b = best
        for k, source, to in ((a, full, low), (b, low, full)):
            if k is not None:
                own[source].remove(k)
                own[to].append(k)
                out[k] = to
                load[source] -= sizes[k]
                load[to] += sizes[k]
    return out


def _exchange(full: list[int], low: list[int], sizes: Sequence[int], gap: int) -> tuple[int, int | None] | None:
    """The slot to move from the full shard, and the one to give for it or None, that brings both closest to half the gap."""
    smaller = sorted([(sizes[k], k) for k in low] + [(0, -1)])
    best, found, at = gap, None, 0
    for n, k in sorted((sizes[k], k) for k in full):
        while at + 1 < len(smaller) and abs(2 * (n - smaller[at + 1][0]) - gap) <= abs(2 * (n - smaller[at][0]) - gap):
            at += 1
        if (off := abs(2 * (n - smaller[at][0]) - gap)) < best:
            best, found = off, (k, None if smaller[at][1] < 0 else smaller[at][1])
    return found


def grown(held: Sequence[int], sizes: Sequence[int], shards: int) -> list[int]:
    """The map with one more shard, which takes slots from the fullest of the others until it has its share; no other slot moves."""
    out, share, load = list(held), sum(sizes) / (shards + 1), [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for k in sorted(range(len(out)), key=lambda k: (sizes[k], k)):
        own[out[k]].append(k)
        load[out[k]] += sizes[k]
    heap, got = [(-n, s) for s, n in enumerate(load)], 0
    heapq.heapify(heap)
    while heap and got < share:
        n, s = heapq.heappop(heap)
        fits = [k for k in own[s] if 0 < sizes[k] <= share - got]
        if fits:
            k = fits[-1]
            own[s].remove(k)
            out[k] = shards
            got += sizes[k]
            heapq.heappush(heap, (n + sizes[k], s))
    return out


def save(spark: SparkSession, folder: str, version: int, held: Sequence[int], sizes: Sequence[int]) -> None:
    """The map as version=<n> below folder; a version that is there is never written again."""
    rows = [(k, s, n) for k, (s, n) in enumerate(zip(held, sizes, strict=True))]
    spark.createDataFrame(rows, "slot int, shard int, bytes long").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """version, slot, shard, bytes: the version asked for, else the last one."""
    maps = spark.read.schema(MAP).parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def placed(records: DataFrame, held: DataFrame, rows: Sequence[int]) -> DataFrame:
    """records (measured) with shard, slot (place in the shard, from 0 without gaps) and map_version."""
    spark = records.sparkSession
    shard = {r.slot: r.shard for r in held.collect()}  # a row a slot
    version = held.select("version").first()
    before, seen = [], {}
    for k in range(len(rows)):
        before.append((k, shard[k], seen.get(shard[k], 0)))
        seen[shard[k]] = seen.get(shard[k], 0) + rows[k]
    table = F.broadcast(spark.createDataFrame(before, "virtual_slot int, shard int, before long"))  # a row a slot
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return records.withColumn("own", own).join(table, "virtual_slot").select("*", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(version[0]).alias("map_version")).drop("own", "before")


def sharded(docs: DataFrame, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each record.

    The maps are kept in folder (by default a new one in the shared folder): where it has none yet, version 0 deals slots out in
    turn; then the last version is edited for the sizes of docs, if that changes it, and stored as the next.
    """
    spark = docs.sparkSession
    fresh_folder, folder = folder is None, folder or new_path(spark, "slot-map")
    records = stored(measured(docs, id_col, text_col, slots), "slot-records")
    sizes, rows = slot_sizes(records, slots)
    if fresh_folder:
        save(spark, folder, 0, in_turn(slots, shards), [0] * slots)
    last = load(spark, folder)
    held = [r.shard for r in last.orderBy("slot").collect()]
    edited = rebalanced(held, sizes, shards)
    if edited != held:
        save(spark, folder, last.first().version + 1, edited, sizes)
    out = placed(records, load(spark, folder), rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def write_shards(docs: DataFrame, folder: str, path: str, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs as files below path/shard=<n>, by the last map of folder. A task writes the records of some slots, so a shard is
    written by many tasks at once."""
    names = [f"`{c}`" for c in docs.columns]
    [slot] = [c for c in ("virtual_slot", "virtual_slot_", "virtual_slot__") if c not in docs.columns][:1]
    held = F.broadcast(load(docs.sparkSession, folder).select(F.col("slot").alias(slot), "shard"))  # a row a slot
    docs.withColumn(slot, slot_of(id_col, text_col, slots)).repartition(slot).join(held, slot).select(*names, "shard").write.partitionBy("shard").parquet(path)

