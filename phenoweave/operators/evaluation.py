"""Evaluation of rankings against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10, 20)


def truth_ranks(ranks: DataFrame, truth: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Best rank of a true id for each case and method that ranked anything; null: not found.

    With aliases both sides are compared by canonical id.
    """
    if alias is not None:
        canon = lambda df: df.join(alias, df["disease_id"] == alias["alias_id"], "left").withColumn("disease_id", F.coalesce("canonical_id", "disease_id")).drop("alias_id", "canonical_id")
        ranks, truth = canon(ranks), canon(truth).distinct()
    hits = ranks.join(truth, ["case_id", "disease_id"], "left_semi").groupBy("case_id", "method").agg(F.min("rank").alias("best_rank"))
    return ranks.select("case_id", "method").distinct().join(hits, ["case_id", "method"], "left")


def metrics(best: DataFrame) -> DataFrame:
    """Recall at cuts, mean reciprocal rank, found share and upper median, by method."""
    r = F.col("best_rank")
    basic = best.groupBy("method").agg(
        F.count("*").alias("n_cases"), F.count(r).alias("n_found"),
        *[F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in CUTS],
        F.round(F.sum(F.coalesce(1.0 / r, F.lit(0.0))) / F.count("*"), 4).alias("mrr"),
    )
    return basic.join(upper_median(best), "method", "left")


def upper_median(best: DataFrame) -> DataFrame:
    """``method, median_rank`` of the found ranks: the least rank that more than half of the others don't exceed.

    Ranks are counted first, so a method is a row for each rank and not for each case.
    """
    counts = best.where("best_rank is not null").groupBy("method", "best_rank").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("method").orderBy("best_rank"))
    total = F.sum("n").over(Window.partitionBy("method"))
    past = counts.select("method", "best_rank", (upto > F.floor(total / 2)).alias("past")).where("past")
    return past.groupBy("method").agg(F.min("best_rank").alias("median_rank"))


def ndcg(ranks: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Binary gains over all relevant ids, normalised by the ideal of min(relevant, k)."""
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    dcg = ranks.where(F.col("rank") <= k).join(relevant, ["case_id", "disease_id"], "left_semi").groupBy("case_id", "method").agg(F.sum(gain).alias("dcg"))
    n = relevant.groupBy("case_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    ideal = F.expr("aggregate(sequence(1, m), 0D, (s, i) -> s + 1 / log2(i + 1D))")
    cases = ranks.select("case_id", "method").distinct().join(n, "case_id").withColumn("ideal", ideal)
    return cases.join(dcg, ["case_id", "method"], "left").select("case_id", "method", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 5).alias("ndcg"))


def agreement_stats(best: DataFrame, within: int = 10) -> DataFrame:
    """Cases by how many methods found the truth within the cut."""
    found = best.groupBy("case_id").agg(F.count_if(F.col("best_rank") <= within).alias("n_found"), F.count("*").alias("n_methods"))
    kind = F.when(F.col("n_found") == 0, "hard").when(F.col("n_found") == F.col("n_methods"), "consensus").when(F.col("n_found") == 1, "unique").otherwise("partial")
    return found.groupBy("n_found", kind.alias("kind")).agg(F.count("*").alias("n_cases"))


def rank_histogram(best: DataFrame) -> DataFrame:
    return best.groupBy("method", "best_rank").agg(F.count("*").alias("n"))


def timing(times: DataFrame) -> DataFrame:
    return times.groupBy("method").agg(F.round(F.avg("seconds"), 3).alias("avg_seconds"), F.count("*").alias("n"))
