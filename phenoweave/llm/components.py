"""Connected components of an edge table, all steps distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, remove


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; the root is the least node.

    Alternating large and small stars: every node's neighbours are moved to the
    least node around it until only stars are left, in a logarithmic number of
    rounds.  Least neighbours are found by combined aggregation and joined back,
    so no list of neighbours is ever gathered.  Each round is a written table.
    Loops and repeated edges are allowed; an empty table gives no rows.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small_least, "a")
        small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small, label)
        new_state = _state(new)
        remove(now, spark)
        now = new
        if new_state == state:
            break
        state = new_state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
