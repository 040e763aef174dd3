"""The screen in single precision loses no pair, and a task's memory does not follow the size of a block or part."""

import tracemalloc

import numpy as np
import pytest

from tessera.operators import screens as S
from tessera.operators import vectors as V


def by_force(d, names, ids, k):
    d = np.where(names[:, None] == ids, np.inf, d)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return [(q, int(ids[i])) for q, o in enumerate(order) for i in o if np.isfinite(d[q, i])]


@pytest.mark.parametrize("copies", [0, 900])
@pytest.mark.parametrize("inner", [False, True])
def test_nearest_with_near_ties(inner, copies):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 12))
    v[1::2] = v[::2] + rng.normal(size=(1500, 12)) * 1e-8  # closer than single precision can tell
    v[:copies] = v[0]
    ids, q, names = rng.permutation(3000), v[:200], np.arange(200)
    part = S.Screen(ids, v, inner=inner)
    d = np.round(-(q @ part.v.T), 12) if inner else S.distances(q, part.v)
    want = by_force(d, names, part.ids, 3)
    last = np.sort(np.where(names[:, None] == part.ids, np.inf, d), axis=1)[:, 2]
    for bound in (np.full(200, np.nan), last):
        at, found, far = part.nearest(names, q, 3, bound)
        assert list(zip(at.tolist(), found.tolist(), strict=True)) == want
        assert np.allclose(far.reshape(200, 3)[:, 2], last, atol=1e-11)
    if not copies:
        assert part.within(q, last, np.zeros(200), 3) is not None  # not all pairs are measured in double


def test_reach_with_limits():
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(2000, 6)), rng.normal(size=(100, 6))
    limit = rng.random(2000) * 2
    part, slope = S.Screen(np.arange(2000), v, limit), rng.random(100) + 0.5
    at, row = part.within(q, np.full(100, 1e-12), slope)
    want = S.distances(q, v) <= slope[:, None] * limit + 1e-12
    got = np.zeros_like(want)
    got[at, row] = True
    assert want.sum() > 100 and not (want & ~got).any()


def test_search_holds_one_batch(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 4))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "id long, v array<double>")
    held = []
    whole = S.meet

    def watched(rows, asks, make, look, schema):
        def one(part, names, *rest):
            tracemalloc.start()
            out = look(part, names, *rest)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            if len(names) * len(part.ids) > S.BATCH_PAIRS or peak > 64 * S.BATCH_PAIRS:
                raise MemoryError(f"{len(names)} queries at once: {peak} bytes")
            return out

        held.append(1)
        return whole(rows, asks, make, one, schema)

    monkeypatch.setattr(V, "meet", watched)
    got = V.nearest(df, df, 2, "id", "v", parts=1, block=4000).collect()
    u = v / np.linalg.norm(np.where(v.any(1)[:, None], v, 1), axis=1)[:, None]
    some = v.any(1)
    d = np.where(some[:, None] & some, np.round(-(u @ u.T), 12), np.inf)
    want = by_force(d, np.arange(4000), np.arange(4000), 2)
    assert held and [(r["query"], r["id"]) for r in sorted(got, key=lambda r: (r["query"], r["rank"]))] == want
