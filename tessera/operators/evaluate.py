"""Scoring of answers: joins to the truth, confusion counts, grouped and voted accuracy, composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import running_number, top_k


def with_default(left: DataFrame, right: DataFrame, key: str, value: str, default: object, order: str | None = None) -> DataFrame:
    """Left rows with the right's value, or a default. Of repeated right keys the last by order counts, as in an index that
    is overwritten."""
    if order:
        right = top_k(right, [key], [F.desc(order)])
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def zipped(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """The i-th with the i-th; as many as the shorter has."""
    return running_number(left, [left_order], "_i").join(running_number(right, [right_order], "_i"), "_i").drop("_i")


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & ~actual).alias("tn"),
        F.count_if(~predicted & actual).alias("fn"),
    ]


def ratios(df: DataFrame, digits: int = 6) -> DataFrame:
    """precision, recall, f1, accuracy and yes_ratio from confusion counts; null where there is nothing to divide by."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    made = {"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r), "accuracy": F.try_divide(tp + tn, total), "yes_ratio": F.try_divide(tp + fp, total)}
    return df.withColumns({k: F.round(v, digits) for k, v in made.items()})


def with_total(df: DataFrame, by: str, total: str, aggregates: Sequence[Column]) -> DataFrame:
    """Grouped aggregates and a row for all, which is told from a null group."""
    out = df.rollup(by).agg(F.grouping_id().alias("_all"), *aggregates)
    return out.withColumn(by, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by).cast("string"))).drop("_all")


def tag_stats(df: DataFrame, tags: Column, value: str, key: str) -> DataFrame:
    """Mean and sample deviation by tag, and over distinct rows as tag all: a row with several tags counts once there."""
    by = df.select(key, value, F.explode(tags).alias("tag"))
    stats = [F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd")]
    whole = by.select(key, value).dropDuplicates([key]).agg(*stats).withColumn("tag", F.lit("all"))
    return by.groupBy("tag").agg(*stats).unionByName(whole)


def vote_score(matches: Column, votes: int = 10) -> Column:
    """Leave-one-out score of an answer with so many matches among the votes: the mean over votes of min(1, others / 3)."""
    c = matches.cast("double")
    return (c * F.least(F.lit(1.0), (c - 1) / 3) + (votes - c) * F.least(F.lit(1.0), c / 3)) / votes


def anls(prediction: Column, truths: Column, floor: float = 0.5) -> Column:
    """The best normalised Levenshtein similarity to any truth, 0 below the floor. Two empty texts are alike."""

    def one(t: Column) -> Column:
        size = F.greatest(F.length(prediction), F.length(t))
        s = F.coalesce(1 - F.try_divide(F.levenshtein(prediction, t).cast("double"), size), F.lit(1.0))
        return F.when(s < floor, 0.0).otherwise(s)

    return F.array_max(F.transform(truths, one))


def product(values: Column) -> Column:
    """Product over an array; a blank one contributes 1."""
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * F.coalesce(x, F.lit(1.0)))


def product_of(x: Column) -> Column:
    """Aggregate: the product of a group's values, from sums alone: of logarithms, of signs and of zeros. Null values contribute 1."""
    size = F.exp(F.sum(F.when(x != 0, F.log(F.abs(x))).otherwise(0.0)))
    sign = F.when(F.count_if(x < 0) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.count_if(x == 0) > 0, 0.0).otherwise(sign * size)


def case_composite(spatial: Column, action: Column, s: Column, a: Column, c: Column) -> Column:
    """(s + a) / 2 of spatial rows, (c + a) / 2 of action rows, else the mean of all three."""
    return F.when(spatial, (s + a) / 2).when(action, (c + a) / 2).otherwise((s + a + c) / 3)


def top_hits(scores: DataFrame, truth: DataFrame, key: str, label: str, score: str, ks: Sequence[int]) -> DataFrame:
    """top_k for each of the ks: is the true class among the k with the largest scores, ties by class? A true class without a score
    is no hit. Scores are counted against the true one's, so that no rank of all classes is needed."""
    own = truth.select(key, F.col(label).alias("_true")).join(scores.select(key, F.col(label).alias("_true"), F.col(score).alias("_own")), [key, "_true"], "left")
    others = scores.select(key, F.col(label).alias("_class"), F.col(score).alias("_score"))
    before = (F.col("_score") > F.col("_own")) | ((F.col("_score") == F.col("_own")) & (F.col("_class") < F.col("_true")))
    place = own.join(others, key, "left").groupBy(key, "_true", "_own").agg(F.count_if(before).alias("_before"))
    return place.select(key, *[(F.col("_own").isNotNull() & (F.col("_before") < k)).alias(f"top_{k}") for k in ks])


def prioritised(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of score tables in which later ones overwrite earlier ones."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("_p", F.lit(k))
        out = f if out is None else out.unionByName(f)
    return top_k(out, [key], [F.desc("_p")]).drop("_p")


def _iou(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    both = side("x0", "x1") * side("y0", "y1")
    return F.try_divide(both, area(a) + area(b) - both)


def distinct_boxes(boxes: Column, threshold: float) -> Column:
    """Boxes (x0, y0, x1, y1, label) in their order, without those that overlap a kept one of their label by `threshold`.

    The reference takes its test of overlap from a module that it does not hold, so the threshold is the caller's."""
    hit = lambda kept, b: F.exists(kept, lambda k: (k["label"] == b["label"]) & F.coalesce(_iou(k, b) >= threshold, F.lit(False)))
    return F.aggregate(boxes, F.filter(boxes, lambda b: F.lit(False)), lambda kept, b: F.when(hit(kept, b), kept).otherwise(F.concat(kept, F.array(b))))
