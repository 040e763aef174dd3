"""Connected components: of graphs, and of the cells of maps of any size.

A map is cut into tiles. Each tile is labelled by itself, a label being the first cell of its piece; pieces whose cells touch over
a border of tiles are edges of a graph, much smaller than the map, whose components join the labels. So a task holds one tile,
whatever the size of a map, and maps of one tile need no second pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import laid_out, numbered

TILE = 256


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of the edges a, b.

    Labels fall to the least of the neighbours' and then to their label's label, which halves what is left of a path: the number
    of rounds grows with the logarithm of the longest one. A round is written before the next.
    """
    both = laid_out(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = laid_out(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        fallen = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "other").alias("new"))
        fallen = laid_out(fallen)
        of = fallen.select(F.col("node").alias("new"), F.col("new").alias("further"))
        moved = laid_out(fallen.join(of, "new", "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new")))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("label <> new").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")


def _pieces(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first cell, row by row, of the piece of each cell; eight neighbours."""
    order = np.lexsort((ys, xs))
    at = {(int(x), int(y)): k for k, (x, y) in enumerate(zip(xs[order], ys[order], strict=True))}
    root = list(range(len(xs)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for (x, y), k in at.items():
        for other in ((x - 1, y - 1), (x - 1, y), (x - 1, y + 1), (x, y - 1)):
            if (j := at.get(other)) is not None:
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    first = np.array([find(k) for k in range(len(xs))], int)
    rx, ry = np.empty(len(xs), np.int64), np.empty(len(xs), np.int64)
    rx[order], ry[order] = xs[order][first], ys[order][first]
    return rx, ry


def labelled_components(grid: DataFrame, by: str, x: str, y: str, on: str, tile: int = TILE) -> DataFrame:
    """component of each cell of each group's map: from 0 by the first cell, row by row; -1 for cells that are off. Eight
    neighbours; cells of a map are distinct."""
    kinds = dict(grid.dtypes)
    cells = grid.select(F.col(by).alias("g"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).where(F.col(on))
    cells = cells.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["rx"], pdf["ry"] = _pieces(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pdf

    piece = F.struct("g", F.col("rx").alias("x"), F.col("ry").alias("y"))
    local = laid_out(cells.groupBy("g", "tx", "ty").applyInPandas(label, f"g {kinds[by]}, x long, y long, tx long, ty long, rx long, ry long").withColumn("piece", piece))
    edge = (F.pmod("x", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("y", F.lit(tile)).isin(0, tile - 1))
    border = local.where(edge)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    sent = border.select("g", "x", "y", "tx", "ty", F.col("piece").alias("a"), near).select("g", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), "tx", "ty", "a").where((F.floor(F.col("x") / tile) != F.col("tx")) | (F.floor(F.col("y") / tile) != F.col("ty")))
    other = border.select(F.col("g").alias("og"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("piece").alias("b"))
    touching = sent.join(other, F.col("g").eqNullSafe(F.col("og")) & (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy"))).select("a", "b").distinct()
    touching = laid_out(touching)
    rows = local.select("g", "x", "y", "piece")
    if touching.limit(1).count():
        joined = components(touching).withColumnRenamed("node", "piece")
        rows = rows.join(joined, "piece", "left").select("g", "x", "y", F.coalesce("component", "piece").alias("piece"))
    firsts = numbered(rows.select("piece").distinct(), ["piece.g", "piece.x", "piece.y"], "place")
    starts = firsts.groupBy(F.col("piece.g").alias("of")).agg(F.min("place").alias("start"))
    numbers = firsts.join(starts, F.col("piece.g").eqNullSafe(F.col("of"))).select("piece", (F.col("place") - F.col("start")).alias("component"))
    found = rows.join(numbers, "piece").select(F.col("g").alias("_g"), F.col("x").alias("_x"), F.col("y").alias("_y"), "component")
    same = F.col(by).eqNullSafe(F.col("_g")) & (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))
    return grid.select(by, x, y).join(found, same, "left").select(by, x, y, F.coalesce("component", F.lit(-1)).cast("long").alias("component"))
