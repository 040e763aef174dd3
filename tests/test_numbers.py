"""Running numbers over many rows with a payload, and what is built on them."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import curate as C
from tessera.operators.common import numbered, ranged


def test_a_million_rows_are_numbered_once(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 1_000_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("key"), F.md5(F.col("id").cast("string")).alias("load"))
        rows = numbered(df, ["key"])
        r = rows.agg(F.countDistinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count_if(F.col("ord") != F.col("key")).alias("off"), F.countDistinct("load").alias("loads")).first()
        assert (r.d, r.lo, r.hi, r.off, r.loads) == (n, 0, n - 1, 0, n)
        assert C.first_rows(df, "key", 123_456).agg(F.max("key"), F.count("*")).first() == (123_455, 123_456)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("alike", [False, True])
def test_a_key_of_a_third_of_the_rows_is_cut(spark, alike):
    """Whether the rows of the key differ elsewhere or not, no range holds twice the mean; columns named as the working ones stay."""
    n, parts = 300_000, 8
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    df = spark.range(n).select(hot.alias("key"), (hot if alike else F.col("id")).alias("_tie"), F.lit("x").alias("_k0"), F.lit("y").alias("_part")).repartition(5)
    sizes = [r["count"] for r in ranged(df, ["key"], parts, "range", "at").groupBy("range").count().collect()]
    assert len(sizes) == parts and max(sizes) < 2 * n / parts and sum(sizes) == n
    rows = numbered(df, ["key"])
    assert rows.columns == [*df.columns, "ord"]
    r = rows.agg(F.countDistinct("ord"), F.min("ord"), F.max("ord"), F.count_if((F.col("_k0") != "x") | (F.col("_part") != "y"))).first()
    assert tuple(r) == (n, 0, n - 1, 0)
    assert rows.groupBy("key").agg((F.max("ord") - F.min("ord") + 1 != F.count("*")).alias("broken")).where("broken").count() == 0


def test_numbers_follow_all_keys(spark):
    """The number is the place in the table sorted by all keys, nulls first."""
    values = [None, 3, 1, 1, None, 2, 2, 2, 9, 0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    got = [r.v for r in numbered(df, [-F.col("v"), "i"]).orderBy("ord").collect()]
    assert got == [None, None, 9, 3, 2, 2, 2, 1, 1, 0]


def test_nothing_is_numbered(spark):
    assert numbered(spark.range(0), ["id"]).count() == 0


def test_fixed_methods_by_sub_category(spark):
    from tessera import schemas
    from tessera.operators.curate import rule_column

    value = F.col("sub")
    rules = [(value == k, F.array(*map(F.lit, v))) for k, v in schemas.PERTURBATIONS.items()]
    df = spark.createDataFrame([(k,) for k in schemas.PERTURBATIONS], "sub string")
    assert {r.sub: r.m for r in df.select("sub", rule_column(value, rules).alias("m")).collect()} == schemas.PERTURBATIONS


@pytest.mark.parametrize("small", [0, 1 << 40])
def test_small_and_large_tables_have_the_same_numbers(spark, monkeypatch, small):
    from tessera.operators import common

    monkeypatch.setattr(common, "SMALL_BYTES", small)
    df = spark.createDataFrame([(k % 5 or None, k % 3, {"m": k}) for k in range(40)], "a int, b int, c map<string,int>")
    rows = common.running_number(df, ["a", "b"], "n", 1).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 41)) and [(r.a, r.b) for r in rows] == sorted(((k % 5 or None, k % 3) for k in range(40)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = {(r.a, r.b, r.n) for r in common.placed(df.drop("c"), ["a"], ["b"], "n").collect()}
    assert {a: sorted(n for x, _, n in got if x == a) for a, _, _ in got} == {a: list(range(1, 9)) for a in (None, 1, 2, 3, 4)}
