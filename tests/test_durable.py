"""Journals: resumed runs equal one run, early stops are exact, and loops are fed by what they made."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions.seams import register_candidates
from tessera.sources import sinks as K
from tessera.streaming import durable as D

SCHEMA = "id long, word string"


def files(folder, rows, size):
    """The rows in files of so many, in the order of their names and times."""
    folder.mkdir()
    for k in range(0, len(rows), size):
        path = folder / f"{k:05d}.json"
        path.write_text("".join(json.dumps({"id": i, "word": w}) + "\n" for i, w in rows[k : k + size]))
        os.utime(path, (1e9 + k, 1e9 + k))


def stream(spark, folder, a_batch=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", a_batch).json(str(folder))


def journal(spark, folder, extra=""):
    return D.Journal(spark, f"file://{folder}", spark.createDataFrame([], SCHEMA + extra).schema)


ROWS = [(i, f"w{i * 7 % 23}") for i in range(60)]


@pytest.mark.parametrize("size", [60, 17, 4])
def test_stops_at_the_number_however_cut(spark, tmp_path, size):
    files(tmp_path / "in", ROWS, size)
    seen = {}
    for i, w in ROWS:
        seen.setdefault(w, i)
    for most in (10, 23, 40):
        j = journal(spark, tmp_path / f"out{most}")
        n = D.distinct_until(stream(spark, tmp_path / "in"), j, ["word"], ["id"], most, str(tmp_path / f"at{most}"))
        want = sorted(seen.items(), key=lambda x: x[1])[:most]
        assert n == len(want) and sorted((r.word, r.id) for r in j.read().collect()) == sorted(want)


def test_a_killed_run_goes_on(spark, tmp_path):
    files(tmp_path / "in", ROWS, 10)
    asked = []

    def answer(fail):
        def run(rows):
            asked.extend(r.word for r in rows.collect())
            if fail and len(asked) > 15:
                raise RuntimeError("killed")
            return rows.withColumn("reply", F.concat(F.lit("re "), "word"))

        return run

    j = journal(spark, tmp_path / "out", ", reply string")
    for fail in (True, False):
        q = D.append_new(stream(spark, tmp_path / "in"), j, ["word"], ["id"], str(tmp_path / "at"), answer(fail))
        try:
            q.awaitTermination()
        except Exception as e:
            assert fail and "killed" in str(e)
    first = {}
    for i, w in ROWS:
        first.setdefault(w, i)
    assert sorted(tuple(r) for r in j.read().collect()) == sorted((i, w, f"re {w}") for w, i in first.items())
    half = journal(spark, tmp_path / "half")
    half.write(spark.createDataFrame(ROWS[:5], SCHEMA), 0)
    half.write(spark.createDataFrame(ROWS[:7], SCHEMA), 0)  # a second try takes the place of the first
    assert half.rows() == 7 and half.last() == 0 and half.rows(0) == 0


def test_a_loop_fed_by_its_output(spark, tmp_path):
    """Each round offers words one longer than the longest example; every second round the examples are refreshed."""

    def make(k, examples):
        longest = examples.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).alias("n"))
        return spark.range(3).join(longest).select("id", F.expr("concat(repeat('a', n + 1), id % 2)").alias("word"))

    want = ["a0", "a1", "aaa0", "aaa1", "aaaaa0"]
    j = journal(spark, tmp_path / "a")
    assert D.feedback(j, make, ["word"], ["id"], 5, 100, 2) == 5 and sorted(r.word for r in j.read().collect()) == want
    k = journal(spark, tmp_path / "b")
    assert [D.feedback(k, make, ["word"], ["id"], 5, n, 2) for n in (1, 3, 100)] == [2, 4, 5]  # stopped twice, and resumed
    assert sorted(r.word for r in k.read().collect()) == want
    assert D.feedback(journal(spark, tmp_path / "c"), make, ["word"], ["id"], 0, 5) == 0


def test_candidates_from_sql(spark):
    def load():
        return lambda row: [(row["item"], f"{row['text']}{k}") for k in range(row["n"])]

    register_candidates(spark, "candidates", load, "item string, text string", 4)
    spark.createDataFrame([("a", 1, "x", 2), ("a", 2, "y", 3), ("b", 1, "z", 0), ("c", 5, "q", 9), ("a", 3, "w", 1)], "item string, at int, text string, n int").createOrReplaceTempView("asks")
    rows = spark.sql("SELECT * FROM candidates(TABLE(asks) PARTITION BY item ORDER BY at)").collect()
    assert sorted((r.item, r.slot, r.text) for r in rows) == [("a", 0, "x0"), ("a", 1, "x1"), ("a", 2, "y0"), ("a", 3, "y1"), *[("c", k, f"q{k}") for k in range(4)]]


def test_checks_in_the_pass_that_writes(spark, tmp_path):
    left, right = spark.range(10).toDF("k"), spark.createDataFrame([(k, f"n{k}") for k in range(9)], "k long, name string")
    with pytest.raises(KeyError, match="1 of 10"):
        K.joined_complete(left, right, "k", f"{tmp_path}/a")
    assert not (tmp_path / "a").exists()
    assert K.joined_complete(left.where("k < 9"), right, "k", f"{tmp_path}/b") == {"rows": 9} and spark.read.parquet(f"{tmp_path}/b").count() == 9
    assert K.checked(right, f"{tmp_path}/c", {"no name": F.col("name").isNull()}) == {"rows": 9}
    with pytest.raises(ValueError, match="large 2"):
        K.checked(right, f"{tmp_path}/d", {"large": F.col("k") > 6, "no name": F.col("name").isNull()})
    assert not (tmp_path / "d").exists()
