"""Closures, propagation, information content and chains over a DAG of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut, dealt


def closure(edges: DataFrame, inclusive: bool = False) -> DataFrame:
    """``term, ancestor`` for all paths."""
    return ancestor_lists(edges, inclusive).select("term", F.explode("up").alias("ancestor"))


def ancestor_lists(edges: DataFrame, inclusive: bool = False) -> DataFrame:
    """``term, up``: each term with the list of its ancestors, or, with ``inclusive``, with itself as well.

    A term is done once all its parents are: it then takes over their lists, so
    each list is written once and sent once along each edge.  What is left after
    that lies on or below cycles and goes by frontiers.
    """
    up = cut(edges.select("child", "parent").distinct())
    kind = edges.schema["parent"].dataType.simpleString()
    tops = up.select(F.col("parent").alias("term")).distinct().join(up.select(F.col("child").alias("term")), "term", "left_anti")
    done = fresh = cut(tops.withColumn("up", F.array().cast(f"array<{kind}>")))
    waiting = up.groupBy("child").agg(F.count("*").alias("open"), F.array().cast(f"array<{kind}>").alias("up"))
    while True:
        given = up.join(fresh.withColumnRenamed("term", "parent"), "parent").select("child", F.lit(-1).alias("open"), F.concat(F.array("parent"), "up").alias("up"))
        met = waiting.select("child", "open", "up").unionByName(given).groupBy("child").agg(F.sum("open").alias("open"), F.array_distinct(F.flatten(F.collect_list("up"))).alias("up"))
        waiting = cut(met)
        fresh = waiting.where("open = 0").select(F.col("child").alias("term"), "up")
        if fresh.limit(1).count() == 0:
            break
        done, waiting = done.unionByName(fresh), waiting.where("open > 0")
    if waiting.limit(1).count():
        done = done.unionByName(_by_frontiers(up, waiting, done))
    own = F.array_union("up", F.array("term")) if inclusive else F.col("up")
    return done.select("term", own.alias("up"))


def _by_frontiers(up: DataFrame, waiting: DataFrame, done: DataFrame) -> DataFrame:
    """Lists of the terms ``waiting (child)``, by distinct frontiers until nothing is new; cycles end."""
    left = cut(up.join(waiting.select(F.col("child").alias("c")), F.expr("child <=> c"), "left_semi"))
    known = frontier = left.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"))
    step = left.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"))
    while True:
        found = frontier.join(step, "ancestor").select("term", F.col("next").alias("ancestor")).distinct()
        frontier = cut(found.join(known, ["term", "ancestor"], "left_anti"))
        if frontier.limit(1).count() == 0:
            break
        known = known.unionByName(frontier)
    above = done.withColumnRenamed("term", "ancestor").select("ancestor", F.explode("up").alias("next"))
    known = known.unionByName(known.join(above, "ancestor").select("term", F.col("next").alias("ancestor"))).distinct()
    return _listed(known)


def _listed(ancestors: DataFrame) -> DataFrame:
    """``term, up`` of rows ``term, ancestor``, null ones too."""
    return ancestors.groupBy("term").agg(F.collect_list(F.struct("ancestor")).alias("x")).select("term", F.col("x.ancestor").alias("up"))


def propagate(terms: DataFrame, ancestors: DataFrame, key: str) -> DataFrame:
    """Terms and all their ancestors; unknown terms stay."""
    return propagate_lists(terms, _listed(ancestors), key)


def propagate_lists(terms: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """:func:`propagate` by ``lists (term, up)``: whole lists go to the keys and are opened where their terms are counted."""
    own = terms.select(key, "term").join(lists, "term", "left").select(key, F.concat(F.array("term"), F.coalesce("up", F.array().cast(lists.schema["up"].dataType))).alias("up"))
    return dealt(own, key).select(key, F.explode("up").alias("term")).distinct()


def document_frequency(profile: DataFrame) -> DataFrame:
    return profile.groupBy("term").agg(F.count_distinct("disease_id").alias("df"))


def information_content(terms: DataFrame, profiles: DataFrame) -> DataFrame:
    """``-ln(df / N)``; N counts all ``profiles (disease_id)``, those without terms as well."""
    n = profiles.agg(F.count("*").alias("n"))  # one row
    return document_frequency(terms).join(F.broadcast(n)).select("term", (-F.log(F.col("df") / F.col("n"))).alias("ic"))


def ic_filter(terms: DataFrame, ic: DataFrame, least: float | None = 1.5) -> DataFrame:
    """Terms of enough information content; terms without one count as 0."""
    if least is None:
        return terms
    return terms.join(ic, "term", "left").where(F.coalesce("ic", F.lit(0.0)) >= least).select(*terms.columns)


def next_parent(edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The parent with the fewest ancestors, ties by id."""
    n = ancestors.groupBy("term").agg(F.count("*").alias("n"))
    sized = edges.join(n, edges["parent"] == n["term"], "left").select("child", "parent", F.coalesce("n", F.lit(0)).alias("n"))
    return sized.groupBy("child").agg(F.min(F.struct("n", "parent")).alias("x")).select(F.col("child").alias("term"), F.col("x.parent").alias("parent"))


def ancestor_chain(edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``term, depth, ancestor``: the chain of next parents, depth 1 nearest."""
    step = next_parent(edges, ancestors)
    now = step.select("term", F.lit(1).alias("depth"), F.col("parent").alias("ancestor"))
    chain, up = cut(now), cut(step.select(F.col("term").alias("ancestor"), "parent"))
    now = chain
    while True:
        now = cut(now.join(up, "ancestor").where("parent <> term").select("term", (F.col("depth") + 1).alias("depth"), F.col("parent").alias("ancestor")))
        if now.limit(1).count() == 0:
            return chain
        chain = chain.unionByName(now)


def category_path(chain: DataFrame, labels: DataFrame, last: int = 5) -> DataFrame:
    """The ``last`` nearest ancestors of the chain with their labels."""
    return chain.where(F.col("depth") <= last).join(labels.withColumnRenamed("term", "ancestor"), "ancestor", "left").select("term", "depth", "ancestor", F.coalesce("label", F.col("ancestor").cast("string")).alias("label"))
