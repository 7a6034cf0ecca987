"""Collapse, fusion and agreement of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import DIGITS, ranked

RRF_K = 60


def rank_methods(scores: DataFrame, k: int = 10) -> DataFrame:
    return ranked(scores, ["case_id", "method"], [F.round("score", DIGITS).desc(), F.col("disease_id")]).where(F.col("rank") <= k)


def collapse(scores: DataFrame, alias: DataFrame) -> DataFrame:
    """Best alias row of each canonical id, with the number of aliases."""
    j = scores.join(alias, scores["disease_id"] == alias["alias_id"], "left").withColumn("canonical_id", F.coalesce("canonical_id", "disease_id"))
    best = F.max(F.struct(F.round("score", DIGITS).alias("score"), (-F.col("disease_id")).alias("d")))
    return j.groupBy("case_id", "method", "canonical_id").agg(best.alias("b"), F.count("*").alias("n_aliases")).select(
        "case_id", "method", "canonical_id", (-F.col("b.d")).alias("best_alias"), F.round("b.score", 6).alias("score"), "n_aliases"
    )


def rrf(ranks: DataFrame, weights: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Sum of ``weight / (60 + rank)``; methods of weight 0 don't count."""
    w = ranks.withColumn("weight", F.lit(1.0)) if weights is None else ranks.join(weights, "method").where("weight <> 0")
    fused = w.groupBy("case_id", "disease_id").agg(
        F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("score"), F.count("*").alias("support"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank")
    )
    top = ranked(fused, ["case_id"], [F.round("score", DIGITS).desc(), F.col("disease_id")]).where(F.col("rank") <= k)
    return top.select("case_id", "rank", "disease_id", F.round("score", 6).alias("score"), "support", "best_rank", "worst_rank", (F.col("worst_rank") - F.col("best_rank")).alias("spread"))


def agreement(ranks: DataFrame) -> DataFrame:
    """Jaccard of the methods' top ids by case: joined on ids, not on all pairs of sets."""
    sizes = ranks.groupBy("case_id", "method").agg(F.count("*").alias("n"))
    a, b = ranks.select("case_id", "disease_id", F.col("method").alias("method_a")), ranks.select("case_id", "disease_id", F.col("method").alias("method_b"))
    common = a.join(b, ["case_id", "disease_id"]).groupBy("case_id", "method_a", "method_b").agg(F.count("*").alias("c"))
    pairs = sizes.select("case_id", F.col("method").alias("method_a"), F.col("n").alias("na")).join(sizes.select("case_id", F.col("method").alias("method_b"), F.col("n").alias("nb")), "case_id")
    out = pairs.join(common, ["case_id", "method_a", "method_b"], "left")
    c = F.coalesce("c", F.lit(0))
    return out.select("case_id", "method_a", "method_b", F.round(c / (F.col("na") + F.col("nb") - c), 6).alias("jaccard"))


def cooccurrence(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("case_id", "disease_id").agg(
        F.count("*").alias("n_methods"), F.round(F.avg("score"), 5).alias("avg_score"), F.round(F.avg("rank"), 5).alias("avg_rank"), F.min("rank").alias("best_rank")
    )


def best_rank_pivot(ranks: DataFrame, methods: list[str]) -> DataFrame:
    return ranks.groupBy("case_id", "disease_id").pivot("method", methods).agg(F.min("rank"))
