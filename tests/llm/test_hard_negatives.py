"""Mined negatives against a version that scores all pairs in plain Python."""

import math
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives
from tessera.llm.queries import oracle_sql, queries

SCHEMA = "vec_id long, label int, embedding array<float>, row string, q string, kind string, part string, anchor string, rank string"


def by_force(rows, anchors, k=5, m=10):
    """rows: (vec_id, label, vector)."""
    held = [(i, lab, [math.floor(Fraction(x) * 256) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, lab, v) in enumerate(held):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, o == lab) for p, (j, o, w) in enumerate(held) if p != n)  # noqa: B905
        for s, j, _ in [x for x in scored if x[2]][:k]:
            found = [(t, o) for t, o, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:m]
            out += [(i, j, r, o, -s, -t) for r, (t, o) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = by_force([(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows], lambda i: i % 100 == 0)
    assert len(want) > 50
    assert rows_of(queries()["op12_hard_negatives"](spark, folder)) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
    got = con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({oracle_sql()['op12_hard_negatives']})").fetchall()
    assert sorted(got) == want


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    """Nulls, vectors of other lengths, ties, repeated ids and rows, clashing names; in one batch and in many."""
    if small:
        monkeypatch.setattr(hard_negatives, "PART_NUMBERS", 8)
        monkeypatch.setattr(hard_negatives, "BATCH_SCORES", 5)
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 3, [1.0 + i % 4 / 8, -0.5, (i % 5) / 7]) for i in range(60)]
    rows += [(0, 0, [1.0, -0.5, 0.0]), (0, 0, [1.0, -0.5, 0.0]), (0, 1, [2.0]), (100, 2, []), (101, 2, [0.5] * 9), (7, 1, rows[7][2])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (200, None, [1.0]), (300, 1, None), (400, 1, [1.0, None]), (500, 1, [nan]), (600, 1, [inf]), (700, 1, [-inf, 1.0])]
    df = spark.createDataFrame([(*r, *("x" * 6)) for r in rows], SCHEMA)
    rows = [(i, lab, None if v is None else v) for i, lab, v in ((r.vec_id, r.label, r.embedding) for r in df.collect())]
    for own, low in ((lambda c: c % 10 == 0, 30), (lambda c: c < 0, 30)):
        assert rows_of(hard_negatives.mined(df, own(F.col("vec_id")), low=low)) == by_force(rows, own)


def test_no_rows(spark):
    assert hard_negatives.mined(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_doubles(spark):
    """Products above 2**53 are added in 64 bits; those above 2**63 are refused."""
    rows = [(0, 0, [2.0**20, 1.0]), (1, 0, [2.0**20 + 1, 1.0]), (2, 1, [2.0**20 * 0.75, 0.5]), (3, 1, [2.0**19, 0.25])]
    df = spark.createDataFrame([(*r, *("x" * 6)) for r in rows], SCHEMA)
    assert rows_of(hard_negatives.mined(df, F.col("vec_id") == 0)) == by_force(rows, lambda i: i == 0) != []
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mined(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6)), F.col("vec_id") == 0).collect()
