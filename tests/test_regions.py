"""Components of graphs and of maps that are cut into tiles, against a flood fill."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.regions import components, labelled_components


def flood(cells):
    found, n = {}, 0
    for c in sorted(cells):
        if c not in found:
            stack, found[c] = [c], n
            while stack:
                i, j = stack.pop()
                for other in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if other in cells and other not in found:
                        found[other] = n
                        stack.append(other)
            n += 1
    return found


def spiral(n):
    """A path that winds through all tiles."""
    return {(i, j) for i in range(n) for j in range(n) if i % 4 == 0 or (j == n - 1 and i % 8 < 4) or (j == 0 and i % 8 >= 4)}


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_maps_in_tiles(spark, tile):
    rng = random.Random(tile)
    maps = {"dense": {(i, j) for i in range(-5, 15) for j in range(20) if rng.random() < 0.5}, "sparse": {(i, j) for i in range(20) for j in range(20) if rng.random() < 0.3}, "spiral": spiral(21), None: {(0, 0), (1, 1), (5, 5)}, "one": {(7, 7)}}
    rows = [(g, i, j, (i, j) in on) for g, on in maps.items() for i in range(-5, 21) for j in range(21)]
    df = spark.createDataFrame([*rows, ("off", 1, 1, False)], "g string, x int, y int, lit boolean")
    got = {(r.g, r.x, r.y): r.component for r in labelled_components(df, "g", "x", "y", "lit", tile).collect()}
    labels = {g: flood(on) for g, on in maps.items()}
    want = {(g, i, j): labels[g].get((i, j), -1) for g, i, j, _ in rows} | {("off", 1, 1): -1}
    assert got == want
    assert labelled_components(df.limit(0), "g", "x", "y", "lit", tile).count() == 0


def test_components_of_a_graph(spark):
    """A long path, a star and single pairs."""
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1300)]
    df = spark.createDataFrame([*path, *star, (2001, 2000), (2000, 2001), (3000, 3000)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 2000: 2000, 2001: 2000, 3000: 3000}
    assert components(df.select(F.struct(F.col("a").alias("n")).alias("a"), F.struct(F.col("b").alias("n")).alias("b")).limit(0)).count() == 0


def test_components_touch_at_corners(spark):
    cells = [(1, r, c, (r, c) in {(0, 0), (1, 1), (3, 3)}) for r, c in itertools.product(range(4), repeat=2)]
    df = spark.createDataFrame(cells, "g int, r int, c int, o boolean")
    got = labelled_components(df, "g", "r", "c", "o").where("component >= 0").select("component").distinct().count()
    assert got == 2
