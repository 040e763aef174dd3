"""Exact quantiles by counting passes and weighted draws by ranges, against numpy."""

import hashlib
import math

import numpy as np
import pytest

from tessera.operators import selection as S

SHAPES = {
    "normal": lambda r, n: r.normal(size=n),
    "ties": lambda r, n: r.integers(0, 3, n).astype(float),
    "one": lambda r, n: np.full(n, 7.0),
    "wide": lambda r, n: 10.0 ** r.uniform(-300, 300, n) * r.choice([-1, 1], n),
    "two and noise": lambda r, n: np.where(r.random(n) < 0.6, 1.0, r.normal(size=n)),
    "infinite": lambda r, n: np.where(r.random(n) < 0.3, np.inf, np.where(r.random(n) < 0.3, -np.inf, r.normal(size=n))),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_of_a_table(spark, shape):
    """With small buffers and a coarse sketch every value takes several passes."""
    values = SHAPES[shape](np.random.default_rng(len(shape)), 4001)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    ordered = np.sort(values)
    for p in (0.0, 0.5, 0.95, 0.999, 1.0):
        at = p * (len(values) - 1)
        lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
        [r] = S.quantile(df, "v", p, small=20, accuracy=25).collect()
        assert r["quantile"] == want or math.isclose(r["quantile"], want, rel_tol=1e-12)


def test_quantiles_by_group(spark):
    """Large and small groups, a null one, one without values, more than go together."""
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in [*"abcdefghijklmnopqrstuvw", None] for v in rng.normal(size=7 if g == "c" else 60)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["quantile"] for r in S.quantile(df, "v", 0.3, "g", small=10, accuracy=20).collect()}
    want = {g: np.quantile([v for o, v in rows if o == g], 0.3) for g in {g for g, _ in rows} - {"none"}}
    assert got.keys() == want.keys() and all(math.isclose(got[g], want[g]) for g in want)
    assert S.quantile(df.limit(0), "v", 0.3).collect() == [] == S.quantile(df.limit(0), "v", 0.3, "g").collect()


def draws_by_force(rows, n, seed):
    rows = sorted((k, w) for k, w in rows if w is not None and w > 0)
    upto = np.cumsum([w for _, w in rows])
    u = [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 2**32 * upto[-1] for i in range(n)]
    return {(i, rows[int(np.searchsorted(upto, x, "right"))][0]) for i, x in enumerate(u)}


@pytest.mark.parametrize("heavy", [1, 100_000])
def test_weighted_draws(spark, heavy):
    """Also where one of the rows has nearly all of the weight."""
    rows = [(k, float(k % 7) if k != 500 else float(heavy)) for k in range(3000)] + [(5000, None), (5001, -3.0)]
    df = spark.createDataFrame(rows, "k long, w double").repartition(3)
    got = S.weighted_draws(df, "k", "w", 5000, "s")
    assert {tuple(r) for r in got.collect()} == draws_by_force(rows, 5000, "s") and got.count() == 5000
    assert S.weighted_draws(df.where("w < 0"), "k", "w", 10, "s").count() == 0 == S.weighted_draws(df, "k", "w", 0, "s").count()
