"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Signals are computed in the row, without a shuffle. For each stratum and signal, labelled good documents are the holdout:
the loosest-to-strictest cutoffs of a fixed grid are candidates, and a cutoff is allowed if an exact one-sided binomial
bound (Clopper-Pearson) on the share of good documents that it rejects is at most `risk`, with the error shared out by
Bonferroni over every candidate of every stratum and signal, and `risk` over the signals. The strictest allowed cutoff is
used; a stratum without one (too few labels) rejects nothing.

Null and empty texts have no words and fail the base rule. A null stratum is a stratum of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import stored

#: Signals: name, cutoffs from the strictest to the loosest; a document is rejected above its cutoff.
GRID = {
    "symbol_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeat_share": [0.02, 0.04, 0.06, 0.08, 0.1, 0.14, 0.18],
    "mean_word_chars": [8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
}
BLANKS = "\t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is not expanded again where it is used."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that stand in a 5-word window found twice or more."""

    def covered(ordered: Column) -> Column:
        same = lambda x, i: (
            ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | ((i < F.size(ordered) - 1) & (F.get(ordered, i + 1)["h"] == x["h"]))
        )
        places = F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["p"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).cast("long").alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 5)
        value = lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(5)]).alias("h"), i.alias("p"))
        return _let(F.sort_array(F.transform(at, value)), covered)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(_let(hashed, windows))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")
    solid = F.translate(text, " " + BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + BLANKS, "") != "")
    row = _let(
        split,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")),
    )
    dup = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    made = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum_col).alias("stratum"),
        row.alias("w"),
        dup.alias("d"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    return made.select(
        "doc_id", "stratum", "w.n_words", "word_chars", "n_symbols", "d.n_dup_lines", "w.n_repeat_words", "d.n_lines"
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _values() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term from logarithms."""
    ratio = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("log_term"), F.exp(n * F.log(F.lit(1 - p))).alias("total"))

    def step(a: Column, j: Column) -> Column:
        term = a["log_term"] + F.log((n - j + 1).cast("double") / j.cast("double")) + ratio
        return F.struct(term.alias("log_term"), (a["total"] + F.exp(term)).alias("total"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["total"])


def surely_rare(k: Column, n: Column, p: float, level: Column) -> Column:
    """P(Binomial(n, p) <= k) <= level, for levels under a half. A median is at most n p rounded up, so that no k of n p or
    more can hold, however large: only the terms below n p are ever summed."""
    return F.when(k < n * p, binomial_tail(k, n, p) <= level).otherwise(F.lit(False))


def fit_cutoffs(scored: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """stratum, rule, cutoff: the strictest cutoff whose false rejections are bounded by risk / rules. scored: of signals();
    confidence: over a half."""
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), v.alias("value")) for r, v in _values().items()])).alias("s")
    good = labels.where("quality = 1").select(F.col("doc_id")).where("doc_id is not null").distinct()
    cuts = F.create_map(*[x for r, c in GRID.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    held = scored.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").select("stratum", rules).select("stratum", "s.rule", "s.value")
    # a document is rejected by the cutoffs below its value: counting by their number needs one row a document and rule
    above = held.select("stratum", "rule", F.size(F.filter(cuts[F.col("rule")], lambda c: c < F.col("value"))).alias("above"))
    counts = above.groupBy("stratum", "rule", "above").agg(F.count("*").alias("n"))
    groups = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("above", "n")).alias("by"))
    many = sum(map(len, GRID.values()))
    tested = groups.withColumn("strata", F.size(F.collect_set(F.coalesce(F.col("stratum").cast("string"), F.lit("\0"))).over(Window.partitionBy("rule")))).select("stratum", "rule", "n", "by", "strata", F.posexplode(cuts[F.col("rule")]).alias("at", "cutoff"))
    rejected = F.aggregate(F.filter("by", lambda x: x["above"] > F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    tested = tested.withColumn("rejected", rejected)
    allowed = tested.where(surely_rare(F.col("rejected"), F.col("n"), risk / len(GRID), (1 - confidence) / (many * F.col("strata"))))
    return allowed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.02, confidence: float = 0.95) -> DataFrame:
    """signals() with kept: neither the base rule nor a fitted cutoff rejects the document."""
    scored = stored(signals(docs), "quality-signals")
    cutoffs = fit_cutoffs(scored, labels, risk, confidence).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    fails = [F.coalesce(v > F.col("cuts")[r], F.lit(False)) for r, v in _values().items()]
    joined = scored.withColumnRenamed("stratum", "own").join(cutoffs, F.col("own").eqNullSafe(F.col("stratum")), "left")
    rejected = fails[0]
    for f in fails[1:]:
        rejected = rejected | f
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept")
    )
