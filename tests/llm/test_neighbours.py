"""The multi-index with all cells visited against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import multi_index


@pytest.mark.parametrize("n", [3, 400])
def test_ties_repeated_vectors_and_clashing_columns(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8)).round(1)
    v[n // 3 : 2 * n // 3] = v[0]  # one vector on a third of the rows: ties at each rank
    v[-1] = v[1] * 2
    rows = [(int(i), x.tolist(), "x", 1, 2, 3) for i, x in enumerate(v)]
    bad = [(n + 1, None), (n + 2, [0.0] * 8), (n + 3, [float("nan")] * 8), (n + 4, [None] * 8), (n + 5, [1.0]), (None, v[0].tolist())]
    df = spark.createDataFrame(rows + [(i, x, "x", 1, 2, 3) for i, x in bad] + rows[:2], "vec_id long, embedding array<double>, q string, v int, cell int, bucket int").repartition(3)
    got = multi_index.search(df, F.col("vec_id") % 7 == 0, visit=1.0, bucket_rows=64).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert sorted(found) == list(range(0, n, 7))
    for q, near in found.items():
        score = u @ u[q]
        want = sorted((i for i in range(n) if i != q), key=lambda i: (-score[i].round(12), i))[:5]
        assert [i for i, _ in near] == want and np.allclose([s for _, s in near], score[want], atol=1e-12)
