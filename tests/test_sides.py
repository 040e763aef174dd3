"""One index for rows of several sides, and a first look that does not measure all pairs in double."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.operators import pivots as P
from tessera.operators import screens as S
from tessera.plans import catalogue


def test_first_look_is_screened(monkeypatch):
    rng = np.random.default_rng(1)
    v, q, limit = rng.normal(size=(6400, 8)), rng.normal(size=(50, 8)), rng.random(6400)
    limit[::7] = np.nan
    part, seen = S.Screen(np.arange(6400), v, limit), []
    d = S.distances(q, v)
    monkeypatch.setattr(S.Screen, "measured", lambda self, q, every=1, whole=S.Screen.measured: seen.append(every) or whole(self, q, every))
    got = P._reached(part, np.arange(50), q, np.full(50, np.nan), np.zeros(50))
    assert seen == [S.STRIDE]
    assert got.column(1).to_pylist() == (d <= limit + P.TOLERANCE).any(1).tolist()
    assert np.allclose(got.column(2).to_numpy(), np.nanmax(limit / (d + P.EPSILON), axis=1))


@pytest.mark.parametrize("n", [1, 7, 8, 61, 4096])
def test_few(n):
    mask = np.random.default_rng(n).random((3, n)) < 0.1
    mask[-1, -1] = True
    want = np.flatnonzero(mask)
    assert S.few(mask, len(want)).tolist() == want.tolist() and S.few(mask, len(want) - 1) is None


def test_sides_are_kept_apart(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 6))
    v[100:200] = v[0]
    side = (np.arange(500) % 5).clip(0, 2)
    df = spark.createDataFrame([(i, x.tolist(), int(s), 0.5) for i, (x, s) in enumerate(zip(v, side, strict=True))], "key long, vec array<double>, side int, radius double")
    ix = P.index(df, "key", "vec", pivots=6, part_rows=60, side=df["side"])
    d = S.distances(v, v)
    alone = np.where((side[:, None] != side) | np.eye(500, dtype=bool), np.inf, d)
    near = {(r["query"], r["rank"]): (r["id"], round(r["measure"], 9)) for r in P.nearest(ix, None, "key", "vec", 3)[0].collect()}
    for i, order in enumerate(np.argsort(alone, axis=1, kind="stable")[:, :3]):
        assert [near[i, r + 1] for r in range(3)] == [(int(o), round(float(d[i, o]), 9)) for o in order]
    some = P.limited(ix, df.where("key < 450").select("key", "radius"), "key", "radius")
    met = (side[:, None] != side) & (np.arange(500) < 450)
    real = np.where(met, 0.5 / (d + P.EPSILON), 0).max(1)
    got = {r["query"]: r for r in P.within(some, None, "key", "vec", ix).collect()}
    assert len(got) == 500
    for i in range(500):
        assert got[i]["hit"] == bool((met & (d <= 0.5 + P.TOLERANCE))[i].any()) and abs(got[i]["realism"] - real[i]) < 1e-6 * real[i]


def test_negative_ids(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(-30, 30), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": np.zeros(60, np.int32)}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    for name in ("knn_radius", "manifold_pr"):
        want = con.execute(catalogue.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        rows = catalogue.queries()[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(tuple, rows)) == [pytest.approx(r, abs=2e-6) if name == "knn_radius" else r for r in sorted(want.fetchall())]
