"""Preference queries over events: each event is one answer of a user (item); even events are base, odd ones negative;
the third of the day is the slot; (value - 50) / 50 is the margin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import prefer as P
from tessera.operators.common import r6
from tessera.operators.curate import complete
from tessera.plans.registry import query, table

_CANDIDATES = """
WITH answers AS (SELECT user_id AS item_id, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'negative' END AS kind,
    hour(ts) // 8 AS slot, (value - 50) / 50 AS margin FROM events),
cand AS (SELECT item_id, kind, slot, round(avg(margin), 6) AS local_score, count(*) FILTER (margin > 0) AS n_yes,
    count(*) FILTER (margin <= 0) AS n_no, min(margin) AS least, max(margin) AS most FROM answers GROUP BY ALL)
"""
_PAIRS = (
    _CANDIDATES
    + """,
pairs AS (SELECT c.item_id, c.slot, c.local_score AS chosen_score, r.local_score AS rejected_score
    FROM cand c JOIN cand r ON c.item_id = r.item_id AND c.slot = r.slot
    WHERE c.kind = 'base' AND r.kind = 'negative' AND c.n_yes > 0 AND c.local_score >= 0.1 AND r.n_no > 0),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY chosen_score DESC, slot) = 1)
"""
)
THRESHOLD = 0.1


def answers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "base").otherwise("negative")
    slot = F.floor(F.hour("ts") / 8).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("item_id"), kind.alias("kind"), slot.alias("slot"), ((F.col("value") - 50) / 50).alias("margin"))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = P.candidate_scores(answers(spark, d))
    return c.where("kind = 'base'"), c.where("kind = 'negative'")


def kept_pairs(spark: SparkSession, d: str) -> DataFrame:
    base, negative = sides(spark, d)
    return P.pairs_by_slot(base.where(P.chosen_verdict(THRESHOLD) == "keep"), negative.where(P.rejected_verdict() == "keep"))


@query(_PAIRS + "SELECT item_id, slot, chosen_score, rejected_score FROM best")
def pair_select(spark, d):
    return P.best_pair(kept_pairs(spark, d))


@query(
    _CANDIDATES
    + """, pairs AS (SELECT c.item_id, c.slot, c.local_score AS chosen_score, r.local_score AS rejected_score,
    round(abs(c.local_score - r.local_score), 6) AS gap FROM cand c JOIN cand r ON c.item_id = r.item_id AND c.slot = r.slot
    WHERE c.kind = 'base' AND r.kind = 'negative' AND c.least > -0.9 AND r.least < -0.5)
SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY gap, slot) = 1"""
)
def pair_select_strict(spark, d):
    base, negative = sides(spark, d)
    return P.closest_pair(P.pairs_by_slot(base.where("least > -0.9"), negative.where("least < -0.5")))


@query(
    _CANDIDATES
    + """, pairs AS (SELECT c.item_id, c.slot, c.local_score AS chosen_score, r.local_score AS rejected_score
    FROM cand c JOIN cand r ON c.item_id = r.item_id AND c.slot = r.slot WHERE c.kind = 'base' AND r.kind = 'negative')
SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5('pick:' || item_id || '/' || slot), slot) = 1"""
)
def pair_random(spark, d):
    return P.random_pair(P.pairs_by_slot(*sides(spark, d)), "pick")


@query(
    _CANDIDATES
    + """SELECT kind, CASE WHEN kind = 'base' THEN CASE WHEN local_score IS NULL THEN 'no_score' WHEN n_yes = 0 THEN 'no_yes'
    WHEN local_score < 0.1 THEN 'low' ELSE 'keep' END ELSE CASE WHEN n_no > 0 THEN 'keep' ELSE 'all_yes' END END AS verdict,
    count(*) AS n FROM cand GROUP BY ALL"""
)
def pair_reject_reasons(spark, d):
    verdict = F.when(F.col("kind") == "base", P.chosen_verdict(THRESHOLD)).otherwise(P.rejected_verdict())
    return P.candidate_scores(answers(spark, d)).groupBy("kind", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    _PAIRS
    + """SELECT b.item_id, c_name, b.slot, ['first ' || c_name, 'second ' || c_name, 'third ' || c_name][b.slot + 1] AS rejected_prompt
    FROM best b JOIN customer ON c_custkey = item_id"""
)
def pair_join_init(spark, d):
    init = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), "c_name")
    prompts = F.array(*[F.concat(F.lit(f"{w} "), "c_name") for w in ("first", "second", "third")])
    best = complete(P.best_pair(kept_pairs(spark, d)), init, "item_id")  # a pair whose item is unknown fails the query
    return best.select("item_id", "c_name", "slot", F.element_at(prompts, (F.col("slot") + 1).cast("int")).alias("rejected_prompt"))


@query(
    _PAIRS
    + """, l AS (SELECT item_id % 4 AS category, 2.0 * (chosen_score - rejected_score - 0.5) AS z, chosen_score, rejected_score FROM pairs)
SELECT category, count(*) AS n, round(avg(ln(1 + exp(-z)) * 0.9 + ln(1 + exp(z)) * 0.1), 6) AS loss,
    round(avg(2.0 * chosen_score - 2.0 * rejected_score), 6) AS reward_margin,
    round(avg(CASE WHEN chosen_score > rejected_score THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l GROUP BY 1"""
)
def pair_loss(spark, d):
    pairs = kept_pairs(spark, d).withColumnsRenamed({"chosen_score": "chosen_logps", "rejected_score": "rejected_logps"})
    losses = P.pair_losses(pairs, beta=2.0, ratio=0.5, smoothing=0.1).withColumn("category", F.col("item_id") % 4)
    return losses.groupBy("category").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("loss", "reward_margin", "accuracy")])


@query(
    """SELECT l_orderkey, round(sum(l_extendedprice * w) / greatest(sum(w), 1.0), 4) AS mean_price, min(l_linenumber) FILTER (w > 0) AS first_line,
    max(l_linenumber) FILTER (w > 0) AS last_line
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS w FROM lineitem) GROUP BY 1"""
)
def masked_mean(spark, d):
    w = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    line = F.when(w > 0, F.col("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(P.masked_mean(F.col("l_extendedprice"), w), 4).alias("mean_price"), F.min(line).alias("first_line"), F.max(line).alias("last_line")
    )
