"""Top-k and rank columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9  # scores are ranked at this precision, so that the order of sums doesn't matter


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "disease_id", name: str = "rank") -> DataFrame:
    """Best ``k`` rows of each group; Spark limits groups before the shuffle."""
    return ranked(df, by, [F.round(score, DIGITS).desc(), F.col(tie)], name).where(F.col(name) <= k)
