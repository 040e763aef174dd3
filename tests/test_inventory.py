"""Methods of the inventory that no query holds: J22, A48, F33, F46, W17, R13, R18."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import curate, evaluate, vectors
from tessera.operators import inventory as I


def test_boxes_go_in_order(spark):
    boxes = [(0.0, 0.0, 2.0, 2.0, "a"), (0.0, 0.0, 2.0, 1.9, "a"), (0.0, 0.0, 2.0, 2.0, "b"), (0.0, 0.0, 2.0, 1.8, "a"), (9.0, 9.0, 9.0, 9.0, "a")]
    df = spark.createDataFrame([(boxes,), ([],)], "b array<struct<x0:double,y0:double,x1:double,y1:double,label:string>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(evaluate.distinct_boxes(F.col("b"), 0.92)).collect()]
    assert got == [[boxes[0], boxes[2], boxes[3], boxes[4]], []]  # the fourth overlaps the dropped second only


def test_entropy_loss(spark):
    rng = np.random.default_rng(0)
    x, book = rng.normal(size=(50, 3)), rng.normal(size=(4, 3))
    z = -2.0 * ((x[:, None] - book) ** 2).sum(2)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    want = -(p * np.log(p)).sum(1).mean() + (p.mean(0) * np.log(p.mean(0) + 1e-7)).sum()
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    assert vectors.entropy_loss(df, book, "v", 2.0) == pytest.approx(want)


def test_plurals(spark):
    nouns = spark.createDataFrame([(0, "Person - people"), (1, "folk - People "), (2, "sheep - sheep")], "ord int, line string")
    df = spark.createDataFrame([("people",), ("sheep",), ("dog",), (None,)], "t string")
    assert sorted(str(r.t) for r in X.singular(df, "t", nouns).collect()) == ["None", "dog", "person", "sheep"]


@pytest.mark.parametrize(
    ("form", "lecture", "want"),
    [
        ("CQM-A", "l", ("Context: c\nQuestion: q\nOptions: o", "Answer: The answer is B.")),
        ("QCML-AE", "", ("Question: q\nContext: c\nOptions: o", "Answer: The answer is B.")),
        ("QCMLE-AEL", "l", ("Question: q\nContext: c\nOptions: o\nBECAUSE: l s", "Answer: The answer is B. BECAUSE: s l")),
        ("QCEM-AL", "l", ("Question: q\nContext: c\nBECAUSE: s\nOptions: o", "Answer: The answer is B. BECAUSE: s")),
        ("QCM-LEA", "l", ("Question: q\nContext: c\nOptions: o", "Answer: l s The answer is B.")),
        ("QCM-LEPA", " ", ("Question: q\nContext: c\nOptions: o", "SOLUTION: s\n###\nANSWER: B.")),
    ],
)
def test_prompts_by_format(spark, form, lecture, want):
    df = spark.createDataFrame([(form, "q", "c", "o", "B", lecture, "s")], "f string, q string, c string, o string, a string, l string, s string")
    cols = [F.col(c) for c in df.columns]
    assert tuple(df.select(*X.assembled(*cols, test=False)).first()) == want
    assert df.select(X.assembled(*cols)[1]).first()[0] == "Answer:"


def test_valid_flag_and_index(spark):
    df = spark.createDataFrame([(256, 255), (256, 256), (None, 300)], "w int, h int")
    assert [r[0] for r in df.select(curate.large_enough(F.col("w"), F.col("h"), 256)).collect()] == [0, 1, 0]
    assert spark.range(1).select(curate.interleaved_index(F.lit(3), F.lit(1), 4, F.lit(32))).first()[0] == 45


@pytest.mark.parametrize(("n", "fill"), [(10, True), (10, False), (2, True), (0, True)])
def test_rank_shards(spark, n, fill):
    ids = list(range(n))
    if fill:
        ids += ids[: -n % 6]
    want = [(r, k, i) for r in range(3) for k, i in enumerate(ids[len(ids) * r // 3 : len(ids) * (r + 1) // 3])]
    got = curate.rank_shards(spark.range(n), ["id"], 3, 6, fill).collect()
    assert sorted((r.rank, r.place, r.id) for r in got) == want


def test_natural_keys(spark):
    words = ["z9", "z10", "Z2a3", "z2a10", "7", "07b", "", "a", "z" + "9" * 30, "z1" + "0" * 30]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    key = lambda w: [int(x) if x.isdigit() else x.lower() for x in re.split("([0-9]+)", w)]
    assert [r.w for r in df.orderBy(I.natural_key(F.col("w")), "w").collect()] == sorted(words, key=lambda w: (key(w), w))


def test_words_in_labels(spark):
    df = spark.createDataFrame([("red car",), ("cargo",), (None,)], "label string")
    words = spark.createDataFrame([("car",), ("red",), ("car",), (None,)], "w string")
    assert sorted(tuple(r) for r in I.containing(df, F.col("label"), words).collect()) == [("cargo", "car"), ("red car", "car"), ("red car", "red")]
    assert I.containing(df, F.col("label"), words.limit(0)).count() == 0
    assert I.containing(df, F.col("label"), spark.range(1001).select(F.concat(F.lit("car"), "id"))).count() == 0  # any number of words


@pytest.mark.parametrize("n", [0, 7, 8, 12])
def test_even_chunks(spark, n):
    rows = [(g, i, (i * 37 + g * 11) % 10) for g in range(3) for i in range(n)]
    want = set()
    for g in range(3):
        items = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        chunks = [[] for _ in range(4)]
        for k, r in enumerate(items):
            room = [c for c in range(4) if len(chunks[c]) < n // 4]
            c = k % 4 if n % 4 else min(room, key=lambda c: (sum(x[2] for x in chunks[c]), c))
            want.add((*r, c, len(chunks[c])))
            chunks[c].append(r)
    df = spark.createDataFrame(rows, "g long, i long, x long").repartition(3)
    assert {tuple(r) for r in I.even_chunks(df, "g", "i", "x", 4).collect()} == want
