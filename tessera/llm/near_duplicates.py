"""Near-duplicate documents by a chosen-path set similarity join on minwise sketches.

1. A document's set is its distinct word 5-shingles (as 64-bit hashes); documents with equal sets are one class.
2. A class has a sketch of WIDTH minwise tokens. In each of `trees` independent trees the root selects coordinates, and
   classes with the same token in a selected coordinate go to the same child. Nodes of at most `small` classes are
   compared exhaustively by their sketches, but for classes so close to one already compared that whoever is linked with
   them has been found. In larger ones all are compared with one head. A class goes on to select coordinates again (the
   choice follows from the path) and branch, up to `depth` times, only if it might be linked with one that is not linked with
   the head: if its sketch agrees with the head's in few enough places more than the best of those does. What then still is
   large is one candidate group.
3. Candidate links make groups, and within a group all links are decided on the full sets, with an inverted index a block.
   Groups of more than BLOCK_CLASSES classes or BLOCK_SHINGLES shingles are dealt into blocks. Blocks are compared within,
   then all with the group's most central member, then with all blocks what is not in the block's own component of a member
   linked with that one: so no pair of different components is left uncompared, and no task holds more than a block.
4. Components of the links give each document the smallest id it can reach.

Only sketches are approximate: a pair at the threshold shares a child of a root with probability 1 - exp(-1.5) a tree, and
its sketches agree in LEAST places or more but for one in a hundred million.

Null texts and texts without words have no shingles and are linked with nothing. Repeated rows are equal documents. Texts are
told apart by what they hold, not by their ids: rows that share an id but not a text are documents of their own, as are rows
without an id, which are always kept and whose component is the smallest id they reach, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.shared import Words, column, mixed, positional, runs_of, stored

SHINGLE = 5
WIDTH, LEAST, CLOSE = 64, 28, 52
#: Names a row of the stored table.
ROW = "__row"
#: Places by which two linked classes may differ in their agreement with a third.
SLACK = CLOSE - LEAST + 1
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 2_000_000
_RNG = np.random.default_rng(1299709)
_ODD = _RNG.integers(1, 2**63, size=(WIDTH, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, size=max(SHINGLE, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and where each text's begin (one more at the end)."""
    w = Words(texts, lower=True)
    h, first = w.hashes(), w.first
    n = np.diff(first)
    wins = np.maximum(n - SHINGLE + 1, 0)
    full = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        full += h[k : k + len(full)] * _PLACE[k]
    full = mixed(full)
    out, sizes = [], np.zeros(len(n), np.int64)
    for d in range(len(n)):
        if wins[d]:
            s = np.unique(full[first[d] : first[d] + wins[d]])
        elif n[d]:
            own = h[first[d] : first[d + 1]]
            s = mixed((own * _PLACE[: len(own)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))
        else:
            continue
        out.append(s)
        sizes[d] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def sketches(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """WIDTH 32-bit minwise tokens of each non-empty set (rows of empty sets are zero)."""
    out = np.zeros((len(first) - 1, WIDTH), np.uint32)
    held = np.flatnonzero(np.diff(first))
    if not len(held):
        return out
    at = 0
    while at < len(held):  # about a quarter of a million hashes at once stay in the cache
        to = max(at + 1, int(np.searchsorted(first[held], first[held[at]] + 250_000)))
        lo, hi = first[held[at]], first[held[to - 1] + 1]
        part, begins = sets[lo:hi], first[held[at:to]] - lo
        for k in range(WIDTH):
            least = np.minimum.reduceat((part ^ _ODD[k, 0]) * _ODD[k, 1], begins)
            out[held[at:to], k] = (mixed(least) >> np.uint64(32)).astype(np.uint32)
        at = to
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Per row: doc_id, text_key (a hash of its text) and other columns of docs asked for, n_shingles, cls (a hash of the set;
    null without shingles), sketch, and the sketch in half the bits, which is enough to compare but not to branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets, first = shingle_sets(column(part, "text"))
                n = np.diff(first)
                some = n > 0
                cls = np.zeros(len(n), np.uint64)
                if some.any():
                    sums = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][some])
                    cls[some] = mixed(sums + n[some].astype(np.uint64) * _PLACE[0])
                sk = sketches(sets, first)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "text_key"), column(part, "row"), pa.array(n), pa.array(_signed(cls), mask=~some), pa.array([s.tobytes() for s in sk], pa.binary()), pa.array([s.tobytes() for s in sk.astype(np.uint16)], pa.binary())],
                    names=["doc_id", "text_key", "row", "n_shingles", "cls", "sketch", "brief"],
                )

    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), row.alias("row"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "doc_id long, text_key long, row long, n_shingles long, cls long, sketch binary, brief binary")


def _starts(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.zeros(b.num_rows, bool)
    change[0] = True
    for k in keys:
        v = column(b, k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), b.num_rows)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))
        self.parts = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.parts -= 1
        return True


def _sketch_matrix(col: pa.Array, of: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), of).reshape(-1, WIDTH)


def _edges_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _node_links(sk: np.ndarray, cls: np.ndarray) -> list[tuple[int, int]]:
    """Each class meets all that are left; those that agree with it in CLOSE places need meet no other."""
    forest, left, pairs = _Forest(len(sk)), np.arange(len(sk)), []
    while len(left) > 1 and forest.parts > 1:
        head, rest = int(left[0]), left[1:]
        agree = (sk[rest] == sk[head]).sum(1)
        for j in rest[agree >= LEAST].tolist():
            if forest.join(head, j):
                pairs.append((int(cls[head]), int(cls[j])))
        # one that is linked with a member that goes must be linked with the head
        left = rest[agree < CLOSE]
    return pairs


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each small node's classes whose sketches agree."""
    for b in runs_of(batches, ["node"]):
        sk, cls, at = _sketch_matrix(column(b, "brief"), np.uint16), column(b, "cls").to_numpy(), _starts(b, ["node"])
        n = np.diff(at)
        pairs: list[tuple[int, int]] = []
        two = at[:-1][n == 2]  # most nodes
        hit = (sk[two] == sk[two + 1]).sum(1) >= LEAST
        pairs += zip(cls[two[hit]].tolist(), cls[two[hit] + 1].tolist(), strict=True)
        for s, m in zip(at[:-1][n > 2].tolist(), n[n > 2].tolist(), strict=True):
            pairs += _node_links(sk[s : s + m], cls[s : s + m])
        yield _edges_batch(pairs)


def _children(branches: float | list[tuple[int, list[int]]]):
    """Rows (node, cls, sketch) one level down. A list names the roots and their coordinates; a number is the branches expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sk, cls = _sketch_matrix(column(b, "sketch")), column(b, "cls").to_numpy()
            nodes, owners = [], []
            if isinstance(branches, list):
                for tree, coords in branches:
                    for c in coords:
                        nodes.append(mixed(sk[:, c].astype(np.uint64) + np.uint64((tree * WIDTH + c) << 32)))
                        owners.append(cls)
            else:
                path = column(b, "node").to_numpy().view(np.uint64)
                bound = np.uint64(int(branches / WIDTH * 2**64))
                for c in range(WIDTH):
                    on = mixed(path ^ _ODD[c, 0]) < bound
                    nodes.append(mixed(path[on] * _ODD[c, 1] + sk[on, c].astype(np.uint64)))
                    owners.append(cls[on])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(nodes))), pa.array(np.concatenate(owners))], names=["node", "cls"])

    return run


def _against_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many places each class's sketch agrees with its head's."""
    for b in batches:
        if b.num_rows:
            agree = (_sketch_matrix(column(b, "brief"), np.uint16) == _sketch_matrix(column(b, "head_brief"), np.uint16)).sum(1)
            yield pa.RecordBatch.from_arrays([column(b, "cls"), column(b, "head"), pa.array(agree.astype(np.int32))], names=["cls", "head", "agree"])


def candidate_links(classes: DataFrame, trees: int, small: int, depth: int) -> DataFrame:
    """a, b: enough links that classes with a Jaccard similarity of 0.75 are connected. classes: cls, sketch, brief."""
    order = np.random.default_rng(31).permutation(WIDTH)
    roots = [(t, [int(order[(2 * t + k) % WIDTH]) for k in range(2)]) for t in range(trees)]
    full, brief = classes.select("cls", "sketch"), classes.select("cls", "brief")
    found = []
    rows = stored(full.mapInArrow(_children(roots), "node long, cls long"), "paths")
    for level in range(1, depth + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("cls").alias("head")).where("size > 1")
        shared = stored(rows.join(sizes, "node").select("node", "cls", "size", "head"), "nodes")
        few = shared.where(F.col("size") <= small).join(brief, "cls").select("node", "cls", "brief").repartition("node").sortWithinPartitions("node")
        found.append(stored(few.mapInArrow(_sketch_links, "a long, b long").distinct(), "sketch-links"))
        many = shared.where(F.col("size") > small)
        if many.limit(1).count() == 0:
            break
        # a group of near copies has the same head in many nodes: each (class, head) is compared once
        heads = brief.select(F.col("cls").alias("head"), F.col("brief").alias("head_brief"))
        pairs = many.where("cls <> head").select("cls", "head").distinct()
        met = stored(pairs.join(brief, "cls").join(heads, "head").select("cls", "head", "brief", "head_brief").mapInArrow(_against_heads, "cls long, head long, agree int"), "met-heads")
        linked = F.col("agree") >= (LEAST if level < depth else 0)
        found.append(met.where(linked).select(F.col("head").alias("a"), F.col("cls").alias("b")))
        if level < depth:
            own = many.join(met, ["cls", "head"]).select("node", "cls", "agree")
            best = own.where(F.col("agree") < LEAST).groupBy("node").agg(F.max("agree").alias("best"))
            apart = own.join(best, "node").where(F.col("agree") < F.col("best") + SLACK).select("node", "cls")
            rows = stored(apart.join(full, "cls").select("node", "cls", "sketch").mapInArrow(_children(4 / 3), "node long, cls long"), "paths")
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    return links


def _exact_links(threshold: int):
    """Links between the members of each (grp, block): residents with residents, or probes with residents if there are any.

    Yields grp, a, b for each link found that joins two parts; without probes also (grp, block's root, member, share) for each
    resident, where share tells how central it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["grp", "block"]
        for b in runs_of(batches, keys):
            at = _starts(b, keys)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = b.slice(s, e - s)
                cls, probe = column(part, "cls").to_numpy(), column(part, "probe").to_numpy(zero_copy_only=False)
                a, c, share = _block_links(column(part, "text"), cls, probe, threshold)
                yield pa.RecordBatch.from_arrays([pa.array([column(part, "grp")[0].as_py()] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(share, pa.float64())], names=["grp", "a", "b", "share"])

    return run


LINKS = "grp long, a long, b long, share double"


def _block_links(texts: pa.Array, cls: np.ndarray, probe: np.ndarray, threshold: int) -> tuple[list, list, list]:
    sets, first = shingle_sets(texts)
    n = np.diff(first)
    _, ids = np.unique(sets, return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    resident = ~probe
    keep = resident[owner]
    post = owner[keep][np.argsort(ids[keep], kind="stable")]
    count = np.bincount(ids[keep], minlength=int(ids.max()) + 1 if len(ids) else 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    share = np.add.reduceat(count[ids], first[:-1]) / np.maximum(n, 1) if len(ids) else np.zeros(len(n))
    forest = _Forest(len(n))
    pairs = []
    # the most central first: after a group's original, all its copies are one component
    for d in (np.argsort(-share, kind="stable") if not probe.any() else np.flatnonzero(probe)).tolist():
        if forest.parts == 1:
            break
        own = ids[first[d] : first[d + 1]]
        lens = count[own]
        flat = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        both = np.bincount(post[flat], minlength=len(n))
        linked = 100 * both >= threshold * (n + n[d] - both)
        linked[d] = False
        for j in np.flatnonzero(linked & resident).tolist():
            if forest.join(d, j):
                pairs.append((int(cls[d]), int(cls[j])))
    if probe.any():
        return [a for a, _ in pairs], [b for _, b in pairs], [None] * len(pairs)
    return [int(cls[forest.find(k)]) for k in range(len(n))], cls.tolist(), share.tolist()


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.select("grp", "block", "cls", "probe", "text").repartition("grp", "block").sortWithinPartitions("grp", "block")


def exact_parts(groups: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """cls, component (one of its classes) of each class of the candidate groups, decided on full sets.
    groups: cls, grp, n_shingles, doc_id, text_key; texts: doc_id, text_key, text."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    placed = groups.join(sizes.select("grp", blocks.alias("blocks")), "grp").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.select("grp", "block", "blocks", "cls", F.col("doc_id").alias("id_of"), F.col("text_key").alias("key_of"))
    # the small side is hashed: texts are shuffled, not sorted
    of = (F.col("text_key") == F.col("key_of")) & F.col("doc_id").eqNullSafe(F.col("id_of"))
    held = stored(texts.join(placed.hint("shuffle_hash"), of).select("grp", "block", "blocks", "cls", F.lit(False).alias("probe"), "text").dropDuplicates(["cls"]), "group-texts")
    once = stored(_dealt(held).mapInArrow(_exact_links(threshold), LINKS), "block-parts")
    hot = held.where("blocks > 1")
    whole = once.select(F.col("b").alias("cls"), F.col("a").alias("component"))
    if hot.limit(1).count() == 0:
        return whole
    parts = hot.select("grp", "cls", "block", "blocks").join(once.select(F.col("b").alias("cls"), F.col("a").alias("part"), "share"), "cls")
    parts = stored(parts, "hot-parts")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def against(probes: DataFrame) -> DataFrame:
        """a, b: links of the probes with all blocks of their group but their own."""
        sent = probes.withColumn("own", F.col("block")).withColumn("block", each).where("block <> own").withColumn("probe", F.lit(True))
        both = hot.select("grp", "block", "cls", "probe", "text").unionByName(sent.select("grp", "block", "cls", "probe", "text"))
        return stored(_dealt(both).mapInArrow(_exact_links(threshold), LINKS).where("share is null").select("grp", "a", "b"), "exact-links")

    chief = stored(parts.groupBy("grp").agg(F.max_by(F.struct("cls", "part"), F.struct("share", "cls")).alias("chief")).select("grp", "chief.*"), "chiefs")
    near = against(hot.join(chief.select("cls"), "cls", "left_semi"))
    # parts of a block that hold the chief or a member linked with it are settled
    reached = parts.join(near.select(F.col("b").alias("cls")), "cls", "left_semi").select("part").unionByName(chief.select("part")).distinct()
    apart = parts.join(reached, "part", "left_anti").select("cls")
    links = near.unionByName(against(hot.join(apart, "cls", "left_semi"))).select("a", "b").unionByName(parts.select(F.col("part").alias("a"), F.col("cls").alias("b")))
    joined = components(links).withColumnRenamed("node", "cls")
    return whole.join(parts.select("cls"), "cls", "left_anti").unionByName(joined)


def _components(rows: DataFrame, texts: DataFrame, threshold: int, trees: int, small: int, depth: int) -> DataFrame:
    """cls, component (a class) and least (its smallest doc_id, if any has one) of all classes that are linked with others.
    rows: of described()."""
    classes = stored(
        rows.where("cls is not null").groupBy("cls")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief"), F.first("n_shingles").alias("n_shingles")),
        "classes",
    )
    grouped = components(candidate_links(classes, trees, small, depth)).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    groups = classes.select("cls", "n_shingles", "at.doc_id", "at.text_key").join(grouped, "cls")
    parts = stored(exact_parts(groups, texts, threshold).join(classes.select("cls", "least"), "cls"), "parts")
    return classes.select("cls", F.col("least").alias("own")).join(
        parts.join(parts.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("cls", "component", "smallest"), "cls", "left"
    ).select("cls", F.coalesce("component", "cls").alias("component"), F.coalesce("smallest", "own").alias("least"))


def near_duplicates(docs: DataFrame, threshold: int = 75, trees: int = 16, small: int = 8192, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs. A row without an id is kept where no row of its component has one."""
    rows = stored(described(docs, id_col, text_col), "described")
    linked = _components(rows, _texts(docs, id_col, text_col), threshold, trees, small, depth).select("cls", "least")
    component: Column = F.coalesce("least", "doc_id")
    joined = rows.select("doc_id", "n_shingles", "cls").join(linked, "cls", "left")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_copies(docs: DataFrame, threshold: int = 75, trees: int = 16, small: int = 8192, depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the first by (doc_id, row), rows without an id last. Rows without shingles stay."""
    plain, (id_at, text_at) = positional(docs, id_col, text_col)
    keyed = stored(plain.withColumn(ROW, F.monotonically_increasing_id()), "copies-rows")
    rows = stored(described(keyed, id_at, text_at, ROW), "described")
    linked = _components(rows, _texts(keyed, id_at, text_at), threshold, trees, small, depth).select("cls", "component")
    of = rows.where("cls is not null").select("cls", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("place"))
    first = of.groupBy("cls").agg(F.min("place").alias("place")).join(linked, "cls").groupBy("component").agg(F.min("place").alias("place"))
    kept = first.select(F.col("place.row").alias(ROW)).unionByName(rows.where("cls is null").select(F.col("row").alias(ROW)))
    return keyed.join(kept.hint("shuffle_hash"), ROW, "left_semi").select(*plain.columns).toDF(*docs.columns)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
