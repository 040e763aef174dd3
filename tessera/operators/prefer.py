"""Preference pairs: scores of candidates, filters with verdicts, matching by slot, selection, and the pair loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import hash_order, top_k

KEY = ["item_id", "kind", "slot"]


def decision(p_yes: Column, p_no: Column) -> Column:
    """yes, no or tie."""
    return F.when(p_yes > p_no, "yes").when(p_yes < p_no, "no").otherwise("tie")


def scored_decision(p_yes: Column, p_no: Column, score: Column) -> Column:
    """The decision, or no_score where the score is null or not a number."""
    return F.when(score.isNull() | F.isnan(score), "no_score").otherwise(decision(p_yes, p_no))


def candidate_scores(answers: DataFrame, digits: int = 6) -> DataFrame:
    """One row a candidate from its answers (item_id, kind, slot, margin): mean margin, counts by decision, extremes.

    Scores are rounded before any threshold is applied, so that the order of summation cannot decide.
    """
    m = F.col("margin")
    return answers.groupBy(*KEY).agg(
        F.round(F.avg(m), digits).alias("local_score"),
        F.count_if(m > 0).alias("n_yes"),
        F.count_if(m <= 0).alias("n_no"),
        F.min(m).alias("least"),
        F.max(m).alias("most"),
        F.count(m).alias("n_answers"),
    )


def chosen_verdict(threshold: float) -> Column:
    """keep, no_yes, no_score (no answers, or not a number) or low. NaN is not above anything here."""
    s = F.col("local_score")
    return F.when(s.isNull() | F.isnan(s), "no_score").when(F.col("n_yes") == 0, "no_yes").when(s < threshold, "low").otherwise("keep")


def rejected_verdict() -> Column:
    """keep if some answer is no; a candidate without answers has none."""
    return F.when(F.col("n_no") > 0, "keep").otherwise("all_yes")


def answers_chosen(answers: Column, score: Column, threshold: float) -> Column:
    """The same test on an array of answer structs."""
    yes = F.exists(answers, lambda a: F.coalesce(F.lower(F.trim(a["answer"])) == "yes", F.lit(False)))
    return yes & ~F.isnan(score) & (score >= threshold)


def answers_rejected(answers: Column) -> Column:
    return F.exists(answers, lambda a: F.coalesce(F.lower(F.trim(a["answer"])) != "yes", F.lit(True)))


def strict_chosen(answers: Column, margin: float = 0.5) -> Column:
    """No answer is no, and every margin is large; true without answers."""
    return F.forall(answers, lambda a: (F.lower(F.trim(a["answer"])) != "no") & (a["p_yes"] - a["p_no"] > margin))


def strict_rejected(answers: Column, margin: float = 0.5) -> Column:
    return F.exists(answers, lambda a: a["p_no"] - a["p_yes"] > margin)


def pairs_by_slot(chosen: DataFrame, rejected: DataFrame, order: str | None = None) -> DataFrame:
    """Each chosen candidate with the first rejected one, by the order, of its item and slot. Without an order each slot holds one."""
    first = top_k(rejected, ["item_id", "slot"], [order]) if order else rejected
    return chosen.select("item_id", "slot", F.col("local_score").alias("chosen_score")).join(
        first.select("item_id", "slot", F.col("local_score").alias("rejected_score")), ["item_id", "slot"]
    )


def best_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the highest chosen score of each item; the earliest slot of equals."""
    return top_k(pairs, ["item_id"], [F.desc("chosen_score"), "slot"])


def closest_pair(pairs: DataFrame) -> DataFrame:
    """The pair with the smallest absolute score gap of each item."""
    gap = F.round(F.abs(F.col("chosen_score") - F.col("rejected_score")), 6)
    return top_k(pairs.withColumn("gap", gap), ["item_id"], ["gap", "slot"])


def random_pair(pairs: DataFrame, seed: str) -> DataFrame:
    return top_k(pairs, ["item_id"], [hash_order(seed, F.concat_ws("/", "item_id", "slot")), "slot"])


def masked_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum of weighted values over the sum of weights, at least 1."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0))


def log_sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def pair_losses(pairs: DataFrame, beta: float, ratio: float, smoothing: float) -> DataFrame:
    """Loss, rewards, margin and accuracy of each pair from chosen_logps and rejected_logps."""
    z = (F.col("chosen_logps") - F.col("rejected_logps") - ratio) * beta
    loss = -log_sigmoid(z) * (1 - smoothing) - log_sigmoid(-z) * smoothing
    return (
        pairs.withColumn("loss", loss)
        .withColumn("chosen_reward", beta * F.col("chosen_logps"))
        .withColumn("rejected_reward", beta * F.col("rejected_logps"))
        .withColumn("reward_margin", F.col("chosen_reward") - F.col("rejected_reward"))
        .withColumn("accuracy", (F.col("chosen_reward") > F.col("rejected_reward")).cast("double"))
    )


