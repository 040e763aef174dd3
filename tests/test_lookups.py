"""Lookups on rows that the tables do not have, readers and writers that no query calls, and streams with late data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import curate as C
from tessera.operators import evaluate as E
from tessera.operators import inventory as I
from tessera.operators import vectors as V
from tessera.sources import readers as R
from tessera.sources import sinks as K
from tessera.streaming import meters as M


def test_leading_turns(spark):
    rows = [(1, 0, "user"), (1, 1, "gpt"), (2, 0, "gpt"), (2, 1, "user"), (3, 0, None), (4, 5, "gpt"), (4, 6, "gpt"), (4, 7, "user")]
    df = spark.createDataFrame(rows, "c int, t int, role string")
    got = C.without_leading(df, ["c"], ["t"], F.col("role") == "user", "n").collect()
    assert sorted((r.c, r.t, r.n) for r in got) == [(1, 0, 0), (1, 1, 1), (2, 1, 0), (4, 6, 0), (4, 7, 1)]


def test_hits_with_ties_and_unknown_classes(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.1), (2, "a", 1.0)], "k int, class string, s double")
    truth = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "k int, class string")
    got = {r.k: (r.top_1, r.top_2) for r in E.top_hits(scores, truth, "k", "class", "s", (1, 2)).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, False)}


def test_missing_fields_and_captions(spark):
    df = spark.createDataFrame([(1, "a", None, 2.0), (2, " ", "x", None)], "k int, a string, b string, n double")
    got = {r.k: r.m for r in df.select("k", C.missing_fields(df, ["a", "b", "n", "never"]).alias("m")).collect()}
    assert got == {1: ["b", "never"], 2: ["a", "n", "never"]}
    assert [(r.k, r.image) for r in C.with_caption_and_image(df, "a", ["b", "a"]).collect()] == [(1, "a"), (2, "x")]


@pytest.mark.parametrize("by", ["l2", "unit l2"])
def test_codes_by_distance(spark, monkeypatch, by):
    """Ties go to the smaller code; the book is sent in parts."""
    monkeypatch.setattr(V, "BOOK_NUMBERS", 8)
    rng = np.random.default_rng(4)
    x, book = rng.normal(size=(50, 4)), rng.normal(size=(7, 4)) * np.arange(1, 8)[:, None]
    book[6] = book[2]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, None)], "i int, v array<double>")
    codes = spark.createDataFrame([(k, b.tolist()) for k, b in enumerate(book)], "code int, centroid array<double>")
    unit = (lambda m: m / np.linalg.norm(m, axis=1)[:, None]) if by != "l2" else (lambda m: m)
    d = np.round(((unit(x)[:, None] - unit(book)[None]) ** 2).sum(2), 9)
    got = {r.i: r.code for r in V.assigned(df, codes, "code", "v", by).collect()}
    assert got == {**{i: int(k) for i, k in enumerate(d.argmin(1))}, 50: None}


def test_any_number_of_words(spark, monkeypatch):
    monkeypatch.setattr(I, "SIDE_VALUES", 5)
    words = spark.createDataFrame([(f"w{k}",) for k in range(23)] + [(None,), ("w3",)], "w string")
    df = spark.createDataFrame([(0, "w1 and w12"), (1, "none"), (2, None)], "i int, t string")
    assert sorted((r.i, r.word) for r in I.containing(df, F.col("t"), words).collect()) == [(0, "w1"), (0, "w1"), (0, "w12")][1:]


def test_moments_and_distance(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) @ np.diag([1, 2, 3]) + 1
    (n, m1, c1), (m, m2, c2) = (V.moments(spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>").repartition(3), "v") for v in (a, b))
    assert (n, m) == (300, 200) and np.allclose(m1, a.mean(0)) and np.allclose(c2, np.cov(b.T))
    values = np.linalg.eigvals(np.cov(a.T) @ np.cov(b.T))
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(np.cov(a.T) + np.cov(b.T)) - 2 * np.sqrt(np.maximum(values.real, 0)).sum()
    assert abs(V.frechet(m1, c1, m2, c2) - want) < 1e-8


def test_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    K.jsonl(rows, f"{tmp_path}/j")
    K.jsonl(rows, f"{tmp_path}/j", append=True)
    assert R.jsonl(spark, f"{tmp_path}/j", "k int, v string", "file").count() == 4
    for n in ("train1.parquet", "test1.parquet"):
        rows.write.parquet(f"{tmp_path}/p/{n}")
    assert R.parquet(spark, f"{tmp_path}/p/*", "part*").count() == 4
    made = K.split_pair(rows, f"{tmp_path}/s", "v")
    assert made == {"a": f"{tmp_path}/s/a_data_1", "b": f"{tmp_path}/s/b_data_1"} and K.counted_name(rows, "x") == "x_2"
    K.spreadsheet(rows, f"{tmp_path}/x")
    assert sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/x", header=True).collect()) == [("1", "a"), ("2", "b")]
    with pytest.raises(ValueError, match="more than 1"):
        K.spreadsheet(rows, f"{tmp_path}/x", 1)
    K.report(rows.agg(F.avg("k")), f"file://{tmp_path}/r.txt")
    assert (tmp_path / "r.txt").read_text() == "score avg:1.5"
    K.scalars(spark.createDataFrame([(1, 0.5, 2)], "step int, loss double, n int"), "step", f"{tmp_path}/m")
    assert {(r.step, r.name, r.value) for r in spark.read.parquet(f"{tmp_path}/m").collect()} == {(1, "loss", 0.5), (1, "n", 2.0)}
    K.masks(spark.createDataFrame([([0.0, 0.3],)], "m array<double>"), "m", f"{tmp_path}/k")
    assert spark.read.parquet(f"{tmp_path}/k").first().m == [0, 1]
    assert K.exactly(rows, 2) is rows
    with pytest.raises(ValueError, match="2 rows"):
        K.exactly(rows, 3)
    (tmp_path / "t.csv").write_text('a,b\n1,"x,y"\n')
    assert tuple(R.read_by_extension(spark, f"{tmp_path}/t.csv", "a int, b string").first()) == (1, "x,y")
    (tmp_path / "b.tsv").write_text("i\tc\n1\teA==\n")
    assert bytes(R.table_text(spark, f"{tmp_path}/b.tsv", "i int, c string", base64_col="c").first().c) == b"x"
    assert R.synthetic(spark, 3, a=1).where("a = 1").count() == 3
    assert R.size_of(spark, f"{tmp_path}/k") == 1 == R.size_of(spark, f"{tmp_path}/k", {"other": 5})
    registry = R.Registry()
    registry.add("rows", lambda spark, n: spark.range(n))
    assert registry.read(spark, "rows", n=4).count() == 4
    (tmp_path / "f").mkdir()
    for k, name in enumerate(("a.png", "b.txt", "c.jpg")):
        (tmp_path / "f" / name).write_bytes(b"x" * (k + 1))
    assert sorted(r["name"] for r in R.files(spark, f"{tmp_path}/f").collect()) == ["a.png", "c.jpg"]
    assert R.latest(R.files(spark, f"{tmp_path}/f")).count() == 1


def test_late_rows_are_left_out(spark, tmp_path):
    """What comes after the watermark has passed its window changes nothing."""
    at = tmp_path / "in"
    at.mkdir()
    batches = [[(1, "2024-01-01T00:10:00"), (2, "2024-01-01T00:20:00")], [(3, "2024-01-01T05:00:00")], [(4, "2024-01-01T00:30:00"), (5, "2024-01-01T05:10:00")], [(6, "2024-01-02T00:00:00")]]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"

    def arrive(k):
        (at / f"{k}.json").write_text("".join(json.dumps({"event_id": i, "ts": t, "user_id": 1, "event_type": "x", "value": 1.0}) + "\n" for i, t in batches[k]))

    arrive(0)
    stream = spark.readStream.schema(schema).json(str(at))
    q = M.windowed(stream, "event_type", "1 hour", delay="1 hour").writeStream.format("memory").queryName("late").outputMode("append").start()
    try:
        q.processAllAvailable()
        for k in (1, 2, 3):
            arrive(k)
            q.processAllAvailable()
        got = {str(r.start): r.n for r in spark.table("late").collect()}
    finally:
        q.stop()
    assert got == {"2024-01-01 00:00:00": 2, "2024-01-01 05:00:00": 2}
