"""Report aggregates over best ranks ``case_id, method, best_rank`` (null: not found)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mrr() -> Column:
    return F.round(F.sum(F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))) / F.count("*"), 4)


def candidate_pool(ranks: DataFrame) -> DataFrame:
    """Ids that any method ranked for a case."""
    return ranks.select("case_id", "disease_id").distinct()


def top_methods(best: DataFrame, n: int) -> DataFrame:
    """The ``n`` methods of greatest mean reciprocal rank, ties by name."""
    return best.groupBy("method").agg(_mrr().alias("mrr")).orderBy(F.desc("mrr"), "method").limit(n)


def single_hit_ndcg(best: DataFrame, k: int = 10) -> DataFrame:
    """One relevant id for each case: the ideal is 1, so the gain is that of the best rank."""
    gain = F.when(F.col("best_rank") <= k, 1.0 / F.log2(F.col("best_rank") + 1.0)).otherwise(0.0)
    return best.select("case_id", "method", F.round(gain, 5).alias("ndcg"))


def benchmark_stats(best: DataFrame) -> DataFrame:
    """Counts, mean and median of found ranks, and shares at 1 and 10, by method."""
    share = lambda k: F.round(F.avg(F.when(F.col("best_rank") <= k, 1.0).otherwise(0.0)), 4)
    return best.groupBy("method").agg(
        F.count("*").alias("n_cases"), F.count("best_rank").alias("n_found"), F.round(F.avg("best_rank"), 4).alias("mean_rank"),
        F.median("best_rank").alias("median_rank"), share(1).alias("top_1"), share(10).alias("top_10"),
    )


def rank_matrix(best: DataFrame, methods: list[str]) -> DataFrame:
    """A row for each case, a column for each of the named methods."""
    return best.groupBy("case_id").agg(*[F.min(F.when(F.col("method") == m, F.col("best_rank"))).alias(m) for m in methods])


def by_dataset(best: DataFrame) -> DataFrame:
    """``dataset, method, n_cases, mrr, recall_10`` of best ranks with a dataset."""
    recall = F.round(F.avg(F.when(F.col("best_rank") <= 10, 1.0).otherwise(0.0)), 4)
    return best.groupBy("dataset", "method").agg(F.count("*").alias("n_cases"), _mrr().alias("mrr"), recall.alias("recall_10"))


def best_method(scores: DataFrame, by: str = "recall_10") -> DataFrame:
    """The method of greatest recall (or another metric) in each dataset, ties by name."""
    r = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(by), "method"))
    return scores.withColumn("_r", r).where("_r = 1").select("dataset", "method", by)


def difficulty(scores: DataFrame) -> DataFrame:
    """Mean, least and greatest recall of the methods on each dataset."""
    r = "recall_10"
    return scores.groupBy("dataset").agg(F.round(F.avg(r), 3).alias("mean_recall"), F.min(r).alias("least_recall"), F.max(r).alias("greatest_recall"))


def ensemble_gain(scores: DataFrame, fused: DataFrame, by: str = "recall_10") -> DataFrame:
    """Recall of the best fusion less that of the best single method, by dataset."""
    single = scores.groupBy("dataset").agg(F.max(by).alias("single"))
    best = fused.groupBy("dataset").agg(F.max(by).alias("fused"))
    return best.join(single, "dataset").select("dataset", "fused", "single", F.round(F.col("fused") - F.col("single"), 4).alias("gain"))
