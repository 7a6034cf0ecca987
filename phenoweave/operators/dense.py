"""Dense vectors: cosine, Euclidean similarity, weighted means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import best_in_blocks
from ..plans.ranking import top_k

QUERY_BLOCK, ITEM_BLOCK = 1024, 4096  # vectors of a block of either side


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"


def cosine_matrix(queries: list, items: list) -> np.ndarray:
    """0 where a vector has no length."""
    q, v = (np.asarray([list(y) for y in x], dtype=float) for x in (queries, items))
    length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
    return np.divide(q @ v.T, length, out=np.zeros(length.shape), where=length > 0)


def euclidean_matrix(queries: list, items: list) -> np.ndarray:
    """``1 / (1 + distance)``; distances by differences, as squares of large vectors cancel."""
    q, v = (np.asarray([list(y) for y in x], dtype=float) for x in (queries, items))
    return np.stack([1 / (1 + np.sqrt(((v - row) ** 2).sum(1))) for row in q]) if len(q) else np.zeros((0, len(v)))


MATRICES = {"cosine": cosine_matrix, "euclidean": euclidean_matrix}


def rank(queries: DataFrame, items: DataFrame, measure: str, k: int = 10) -> DataFrame:
    """The k items ``disease_id, vector`` nearest to each query ``patient_id, vector``, block by block."""
    q = queries.select(F.col("patient_id").alias("id"), F.col("vector").alias("v"))
    v = items.select(F.col("disease_id").alias("id"), F.col("vector").alias("v"))
    best = best_in_blocks(q, v, MATRICES[measure], k, QUERY_BLOCK, ITEM_BLOCK, 5)
    return top_k(best.withColumn("score", F.round("score", 5)), ["patient_id"], k).select("patient_id", "rank", "disease_id", "score")


def rank_canonical(queries: DataFrame, items: DataFrame, alias: DataFrame, measure: str = "cosine", k: int = 10, pool: int | None = None) -> DataFrame:
    """Ranks canonical ids by their best alias; ``alias_id`` is the best one.

    With ``pool`` the items are cut to so many before they are collapsed, as an
    index that knows no aliases does; else aliases of all ids that can be among
    the best are looked at.
    """
    most = alias.groupBy("canonical_id").count().agg(F.max("count")).first()[0] or 1 if pool is None else 1
    found = rank(queries, items, measure, pool or k * most)
    named = found.join(alias, found["disease_id"] == alias["alias_id"], "left").withColumn("canonical_id", F.coalesce("canonical_id", "disease_id"))
    best = named.groupBy("patient_id", "canonical_id").agg(F.max(F.struct("score", (-F.col("disease_id")).alias("d"))).alias("x"), F.count("*").alias("n_aliases"))
    best = best.select("patient_id", F.col("canonical_id").alias("disease_id"), (-F.col("x.d")).alias("alias_id"), "x.score")
    return top_k(best, ["patient_id"], k).select("patient_id", "rank", "disease_id", "alias_id", "score")


def mean_pool(tokens: DataFrame, key: str) -> DataFrame:
    """Mean of the token vectors ``key, vector, mask`` by mask, in rows ``key, dim, value``; an all-zero mask gives zeros."""
    long = tokens.select(key, "mask", F.posexplode("vector").alias("dim", "x"))
    return long.groupBy(key, "dim").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-9))).alias("value"))


def gathered(long: DataFrame, key: str) -> DataFrame:
    """``key, vector`` from rows ``key, dim, value``."""
    listed = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("x"))
    return listed.select(key, F.transform("x", lambda e: e["value"]).alias("vector"))


def weighted_mean(vectors: DataFrame, weights: DataFrame, key: str, digits: int | None = 5) -> DataFrame:
    """``key, dim, value``: weighted mean of the vectors of a key's terms; missing weights are 1."""
    long = vectors.join(weights, "term", "left").select(key, F.coalesce("weight", F.lit(1.0)).alias("w"), F.posexplode("vector").alias("dim", "x"))
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    return long.groupBy(key, "dim").agg((mean if digits is None else F.round(mean, digits)).alias("value"))


def l2_normalize(items: DataFrame) -> DataFrame:
    return items.withColumn("vector", F.expr(f"transform(vector, x -> x / greatest(sqrt({_dot('vector', 'vector')}), 1e-12D))"))
