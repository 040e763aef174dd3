"""Neighbours and reach by the pivot index against all pairs, and how many pairs it compares."""

import numpy as np
import pytest

from tessera.operators import pivots as P


def clustered(seed, n=1500, d=8, groups=30):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, d)) * 10
    v = at[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.1
    v[: n // 3] = at[0]  # a third of the rows are equal
    return v


def table(spark, v, extra=()):
    return spark.createDataFrame([(i, x.tolist(), float(i % 5) / 50) for i, x in enumerate(v)] + list(extra), "key long, vec array<double>, radius double")


def by_force(v, q, ids, k):
    d = P.distances(q, v)
    d[ids[:, None] == np.arange(len(v))] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(int(i), int(o), r + 1, round(float(d[n, o]), 9)) for n, i in enumerate(ids) for r, o in enumerate(order[n]) if np.isfinite(d[n, o])}


@pytest.mark.parametrize(("kind", "block"), [("clusters", 8_000_000), ("clusters", 64), ("none", 8_000_000)])
def test_nearest_is_exact(spark, monkeypatch, kind, block):
    monkeypatch.setattr(P, "BOUND_NUMBERS", block)  # with 64 the bounds are sent in many blocks
    n = 1500 if block > 64 else 300
    v = clustered(1, n) if kind == "clusters" else np.random.default_rng(1).normal(size=(700, 16))
    df = table(spark, v, [(9999, None, 1.0)])
    ix = P.index(df, "key", "vec", pivots=8, part_rows=100)
    assert ix.bounds.count() == -(-len(v) // 100) and ix.bounds.agg({"n": "max"}).first()[0] == 100
    near, compared = P.nearest(ix, df, "key", "vec", 4)
    got = {(r.query, r.id, r.rank, round(r.measure, 9)) for r in near.collect()}
    assert got == by_force(v, v, np.arange(len(v)), 4)
    pairs = sum(r.compared for r in compared.collect())
    assert pairs <= len(v) ** 2
    if kind == "clusters" and n > 1000:
        assert pairs < 0.25 * len(v) ** 2  # also the third of the rows that are copies do not all meet


def test_reach_is_exact(spark):
    v, q = clustered(2, 600), clustered(3, 400)
    q[:200] = v[200:400] + 0.01
    ix = P.index(table(spark, v), "key", "vec", "radius", pivots=8, part_rows=50)
    out = P.within(ix, table(spark, q), "key", "vec").collect()
    d, r = P.distances(q, v), np.arange(600) % 5 / 50
    hit, real = (d <= r + P.TOLERANCE).any(1), (r / (d + P.EPSILON)).max(1)
    assert {(x.query, x.hit, round(x.realism, 6)) for x in out} == {(i, bool(hit[i]), round(float(real[i]), 6)) for i in range(400)}
    assert 0 < hit.sum() < 400 and sum(x.compared for x in out) < 0.5 * d.size


def test_few_rows_and_none(spark):
    v = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    ix = P.index(table(spark, v), "key", "vec")
    near, _ = P.nearest(ix, table(spark, v), "key", "vec", 5)
    assert sorted((r.query, r.id, r.rank) for r in near.collect()) == [(0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 2, 1), (2, 0, 2), (2, 1, 1)]
    none = P.index(table(spark, v[:0]), "key", "vec", "radius")
    assert P.nearest(none, table(spark, v), "key", "vec", 2)[0].count() == 0 and P.within(none, table(spark, v), "key", "vec").count() == 0
    assert P.nearest(ix, table(spark, v[:0]), "key", "vec", 2)[0].count() == 0
