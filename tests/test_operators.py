"""Edges that the tables do not have."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import arrays, curate, evaluate, meters, prefer
from tessera.operators.common import numbered


def value(spark, column, *args):
    return spark.range(1).select(column.alias("x")).first()[0]


ANSWER = "array<struct<p_yes:double,p_no:double,answer:string>>"


@pytest.mark.parametrize(
    ("answers", "score", "chosen", "rejected"),
    [([], 0.9, False, False), (["yes"], 0.6, True, False), ([" Yes ", "no"], 0.59, False, True), (["tie"], 0.9, False, True), (["no"], float("nan"), False, True), (["yes"], float("nan"), False, False), ([None], 0.9, False, True)],
)
def test_filters(spark, answers, score, chosen, rejected):
    df = spark.createDataFrame([([(0.9, 0.1, a) for a in answers], score)], f"a {ANSWER}, s double")
    assert tuple(df.select(prefer.answers_chosen(F.col("a"), F.col("s"), 0.6), prefer.answers_rejected(F.col("a"))).first()) == (chosen, rejected)


def test_strict_filters_on_no_answers(spark):
    df = spark.createDataFrame([([],)], f"a {ANSWER}")
    assert tuple(df.select(prefer.strict_chosen(F.col("a")), prefer.strict_rejected(F.col("a"))).first()) == (True, False)


def test_ties_go_to_the_first_slot(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5, 0.1), (1, 0, 0.5, 0.2), (1, 1, 0.4, 0.3)], "item_id int, slot int, chosen_score double, rejected_score double")
    assert prefer.best_pair(pairs).first().slot == 0
    assert prefer.closest_pair(pairs).first().slot == 1


def test_loss_does_not_overflow(spark):
    df = spark.createDataFrame([(1000.0, -1000.0), (-1000.0, 1000.0)], "chosen_logps double, rejected_logps double")
    assert [round(r.loss) for r in prefer.pair_losses(df, 1.0, 0.0, 0.0).collect()] == [0, 2000]


def test_vote_score_is_the_leave_one_out_mean(spark):
    rng = random.Random(5)
    for _ in range(20):
        votes = [rng.choice("abc") for _ in range(10)]
        for a in set(votes):
            means = [min(1, sum(v == a for j, v in enumerate(votes) if j != i) / 3) for i in range(10)]
            assert value(spark, evaluate.vote_score(F.lit(votes.count(a)))) == pytest.approx(sum(means) / 10)


def test_anls_edges(spark):
    one = lambda p, *t: value(spark, evaluate.anls(F.lit(p), F.array(*map(F.lit, t))))
    assert one("", "") == 1.0 and one("", "abc") == 0.0 and one("ab", "ax") == 0.5 and one("ab", "zz", "ab") == 1.0


@pytest.mark.parametrize(("text", "want"), [("a:1;b:2;c:x:3", ["1", "2", "3"]), ("a;b", None), ("a;b;c;d", None)])
def test_semicolon_fields(spark, text, want):
    assert value(spark, X.semicolon_fields(F.lit(text))) == want


def test_question_split(spark):
    assert value(spark, X.split_questions(F.lit("Is it red? ...? Is it red? USER: x? tail"))) == ["Is it red?", "tail?"]


@pytest.mark.parametrize(("text", "want"), [("NO", "yes"), ("not here", "no"), ("Yes, no", "no"), ("nothing", "yes"), ("Yes. no", "yes"), ("No", "no")])
def test_yes_or_no(spark, text, want):
    assert value(spark, X.yes_or_no(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [("B", "B"), ("B. text", "B"), ("The answer is C.", "C"), ("The answer is C. The answer is D.", "FAILED"), ("F", "FAILED")])
def test_choice_letter(spark, text, want):
    assert value(spark, X.choice_letter(F.lit(text), list("ABCDE"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("1,000", "1000"), ("U.S.", "us"), ("dont", "don't"), ("two cats", "2 cats"), ("the", ""), ("a\nb", "b"), ("x" + "." * 40, "x" + "." * 8), ("red-ish", "red ish"), ("red- ish", "red ish"), ("3.5", "3.5")],
)
def test_answer_normaliser(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.normalised_answer("t")).first()[0] == want


def test_blob_types(spark):
    heads = {"jpg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF89a", "ico": b"\0\0\1\0", "webp": b"RIFF\0\0\0\0WEBP", "bin": b"????"}
    df = spark.createDataFrame([(k, v + b"\0" * (12 - len(v)) if len(v) < 12 else v) for k, v in heads.items()] + [("bin", b"\xff\xd8\xff")], "want string, b binary")
    assert all(r.want == r.got for r in df.select("want", X.blob_type(F.col("b")).alias("got")).collect())


def test_caption_cleaner(spark):
    df = spark.createDataFrame([("<b>Blue</b>+T-Shirt http://x.com/a #123 &amp;amp; 10.0.0.1 free shipping",)], "t string")
    assert df.select(X.cleaned_caption(F.col("t"))).first()[0] == "blue t-shirt ;"  # an entity within an entity leaves its end


def test_caps_and_splits(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(11)], "id int, c string")
    assert curate.running_ids(df, F.lit("0"), ["c"], ["id"], cap=2).count() == 4
    assert curate.running_ids(df, F.lit("0"), ["c"], ["id"], cap=2, literal_cap=True).count() == 6
    split = curate.stratified_split(df, "c", "id", 0.1, "s")
    assert split.where("split = 'val'").count() == 0  # fewer rows than 1 / ratio
    assert [r.id for r in curate.slice_rows(df, ["id"], -3, None).orderBy("id").collect()] == [8, 9, 10]
    assert curate.chunks(df, "id", 4).groupBy("chunk").count().where("count > 3").count() == 0


def test_completeness_raises(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no match for 2"):
        curate.complete(left, right, "k").collect()


def test_numbered_over_partitions(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("v"))
    assert numbered(df, ["v"], "n").where("n * 3 <> v").count() == 0


def test_otsu_constant_and_clusters(spark):
    one = spark.createDataFrame([("a", 0.5)] * 5 + [("b", x) for x in (0.1, 0.12, 0.9, 0.92)], "g string, x double")
    found = {r.g: r.threshold for r in arrays.otsu(one, "x", ["g"]).collect()}
    assert 0.1 < found["b"] < 0.9 and "a" in found


def test_nucleus_keeps_a_dominant_token(spark):
    df = spark.createDataFrame([(1, "a", 0.95), (1, "b", 0.05)], "g int, t string, p double")
    kept = df.select("t", arrays.nucleus_kept("p", ["g"], "t", 0.9).alias("k")).where("k").collect()
    assert [r.t for r in kept] == ["a"]
    assert df.where(F.lit(True)).select(arrays.nucleus_kept("p", ["g"], "t", 1.0).alias("k")).where("k").count() == 2


def test_islands_and_ema(spark):
    df = spark.createDataFrame([(1, i, k, float(i)) for i, k in enumerate("aabba")], "u int, i int, k string, v double")
    assert [r.island for r in meters.islands(df, "k", ["u"], ["i"]).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    want = 0.0
    for i in range(1, 5):
        want = 0.9 * want + 0.1 * i
    assert meters.ema(df, "v", ["u"], ["i"]).first().ema == pytest.approx(want)


def test_products_from_sums(spark):
    from tessera.operators.evaluate import product_of

    groups = {"a": [2.0, -3.0, None, 0.5], "b": [0.0, -1.0, 5.0], "c": [-1.0, -1.0, -7.25], "d": [None], "e": [1e200, 1e-200, 3.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    got = {r.g: r.p for r in df.groupBy("g").agg(product_of(F.col("x")).alias("p")).collect()}
    for g, xs in groups.items():
        want = 1.0
        for x in xs:
            want *= 1.0 if x is None else x
        assert abs(got[g] - want) <= 1e-9 * max(1.0, abs(want))
