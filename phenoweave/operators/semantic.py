"""Semantic similarity by the most informative common ancestor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import best_in_blocks
from ..plans.ranking import DIGITS, ranked, top_k
from .ontology import ic_filter

#: Similarity of ``a`` and ``b`` through a common ancestor ``x``.
MEASURES = {
    "resnik": "ic_x",
    "lin": "CASE WHEN ic_a + ic_b > 0 THEN 2 * ic_x / (ic_a + ic_b) ELSE 0D END",
    "jiang_conrath": "1 / (1 + greatest(0D, ic_a + ic_b - 2 * ic_x))",
}
PATIENT_BLOCK, PROFILE_BLOCK = 512, 32_768  # rows of a block of either side; wide, as a term is scored once for all profiles of a block
PATIENTS, PROFILES = 128, 4096  # rows that are scored at a time
CHUNK = 128  # terms or sets that are scored at a time, so that what they need stays in the cache
MOST_PATHS = 5_000_000  # pairs of term and ancestor that may be broadcast


def mica(pairs: DataFrame, ancestors: DataFrame, ic: DataFrame) -> DataFrame:
    """``a, b, mica, ic_mica`` of distinct term pairs ``a, b`` with a common ancestor (or equal).

    ``ancestors`` includes each term itself; a missing information content is 0.
    Ties take the greater id.  Each pair stays one row that meets the lists of both
    terms' ancestors.
    """
    weighed = ancestors.join(ic.select(F.col("term").alias("ancestor"), "ic"), "ancestor", "left").withColumn("ic", F.coalesce("ic", F.lit(0.0)))
    lists = weighed.groupBy("term").agg(F.collect_list(F.struct(F.round("ic", DIGITS).alias("r"), "ancestor", "ic")).alias("up"))
    best = F.array_max(F.array_intersect("up_a", "up_b"))
    return with_both(pairs, lists).withColumn("x", best).where("x is not null").select("a", "b", F.col("x.ancestor").alias("mica"), F.col("x.ic").alias("ic_mica"))


def with_both(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the lists ``up_a`` and ``up_b`` of ``lists (term, up)``."""
    for side in "ab":
        pairs = pairs.join(lists.select(F.col("term").alias(side), F.col("up").alias(f"up_{side}")), side)
    return pairs


def common_ancestors(pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``a, b, ancestor`` of distinct pairs; a pair stays one row until its ancestors are known."""
    lists = ancestors.groupBy("term").agg(F.collect_list("ancestor").alias("up"))
    return with_both(pairs, lists).select("a", "b", F.explode(F.array_intersect("up_a", "up_b")).alias("ancestor"))


def mica_distance(micas: DataFrame, ic: DataFrame) -> DataFrame:
    """Jiang-Conrath distance of the pairs of :func:`mica`; pairs without a common ancestor aren't there."""
    one, two = (ic.select(F.col("term").alias(k), F.coalesce("ic", F.lit(0.0)).alias(f"ic_{k}")) for k in "ab")
    gap = F.coalesce("ic_a", F.lit(0.0)) + F.coalesce("ic_b", F.lit(0.0)) - 2 * F.col("ic_mica")
    return micas.join(one, "a", "left").join(two, "b", "left").select("a", "b", "mica", F.greatest(F.lit(0.0), gap).alias("distance"))


def rank(patient: DataFrame, profile: DataFrame, ancestors: DataFrame, ic: DataFrame, measure: str, least_ic: float | None = None, k: int = 10) -> DataFrame:
    """Top k profiles of each patient by best match average, all patients against all profiles.

    Both sides lose terms of less information content than ``least_ic``; patients
    and profiles without terms left are out.  The score is the mean of two directed
    averages of best scores; terms without a common ancestor score 0.  Blocks of
    patients meet blocks of profiles; the ontology goes to each task if it is
    small, else scores are made by joins.
    """
    patient, profile = (ic_filter(x, ic, least_ic) for x in (patient, profile))
    up = ancestors.join(ic.select(F.col("term").alias("ancestor"), F.col("ic").alias("ic_x")), "ancestor", "left").select("term", "ancestor", F.coalesce("ic_x", F.lit(0.0)).alias("ic_x"))
    paths = up.limit(MOST_PATHS + 1).toPandas() if up.count() <= MOST_PATHS else None
    if paths is None:
        scored = best_match_average(patient, profile, ancestors, ic, measure)
    else:
        scored = _in_blocks(patient, profile, paths, ic.toPandas(), measure, k)
    return top_k(scored, ["patient_id"], k).select("patient_id", "rank", "disease_id", F.round("score", 5).alias("score"))


class _Ontology:
    """Terms by position, with their ancestors and information content."""

    def __init__(self, paths: pd.DataFrame, ic: pd.DataFrame):
        self.ids = np.unique(np.concatenate([paths["term"].to_numpy(), paths["ancestor"].to_numpy(), ic["term"].to_numpy()]))
        self.ic = np.zeros(len(self.ids))
        self.ic[np.searchsorted(self.ids, ic["term"].to_numpy())] = ic["ic"].to_numpy()
        term, above = (np.searchsorted(self.ids, paths[c].to_numpy()) for c in ("term", "ancestor"))
        order = np.argsort(term, kind="stable")
        self.above = above[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.ids) + 1))

    def position(self, terms: np.ndarray) -> np.ndarray:
        """-1 for terms that the ontology doesn't have."""
        at = np.minimum(np.searchsorted(self.ids, terms), max(len(self.ids) - 1, 0))
        return np.where(self.ids[at] == terms, at, -1) if len(self.ids) else np.full(len(terms), -1)

    def ancestors_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ancestors of all terms in a row, and how many each has."""
        n = self.start[terms + 1] - self.start[terms]
        first = np.repeat(self.start[terms] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else n
        return self.above[first + np.arange(n.sum())], n


def _through(measure: str) -> Callable:
    """Similarity by the ancestor's, the term's and the other side's least information content (infinite: none), at least 0."""
    if measure == "resnik":
        return lambda x, a, b: np.where(np.isfinite(b), x, 0.0)
    if measure == "lin":
        return lambda x, a, b: np.divide(2 * x, a + b, out=np.zeros(b.shape), where=a + b > 0)
    return lambda x, a, b: 1 / (1 + np.maximum(0, a + b - 2 * x))


def _least(o: _Ontology, sets: list[np.ndarray], rows: np.ndarray, positive: bool) -> np.ndarray:
    """Of each ancestor in ``rows`` and each set the least information content of the set's terms below it."""
    terms, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    use = (terms >= 0) & (o.ic[terms] > 0 if positive else True)
    above, n = o.ancestors_of(terms[use])
    place, value = np.repeat(place[use], n), np.repeat(o.ic[terms[use]], n)
    at = np.minimum(np.searchsorted(rows, above), len(rows) - 1)
    hit = rows[at] == above
    out = np.full((len(rows), len(sets)), np.inf)
    np.minimum.at(out, (at[hit], place[hit]), value[hit])
    return out


def _directed(o: _Ontology, own: list[np.ndarray], other: list[np.ndarray], measure: str) -> np.ndarray:
    """Mean best score of each set in ``own`` against each set in ``other``.

    Of the other side's terms below an ancestor only the least informative one
    counts: through one ancestor all measures fall with it.
    """
    terms, back = np.unique(np.concatenate(own), return_inverse=True)
    best, known = np.zeros((len(terms) + 1, len(other))), np.flatnonzero(terms >= 0)  # the last row is no term
    above, n = o.ancestors_of(terms[known])
    if len(above):
        rows, through = np.unique(above), _through(measure)
        at, mine = _padded(np.searchsorted(rows, above), n), o.ic[terms[known]]
        zero = (mine == 0) if measure == "lin" else np.zeros(len(known), dtype=bool)  # Lin is 0 if both are
        weight = np.append(o.ic[rows], 0.0)
        for some, positive in ((~zero, False), (zero, True)):
            which = np.flatnonzero(some & (n > 0))
            if len(which):
                least = np.vstack([_least(o, other, rows, positive), np.full(len(other), np.inf)])
            for lo in range(0, len(which), CHUNK):
                part = which[lo : lo + CHUNK]
                top = np.zeros((len(part), len(other)))
                for k in range(n[part].max()):
                    x = at[part, k]
                    np.maximum(top, through(weight[x][:, None], mine[part][:, None], least[x]), out=top)
                best[known[part]] = top
    sizes = np.array([len(x) for x in own])
    members, out = _padded(back, sizes, len(terms)), np.zeros((len(own), len(other)))
    for lo in range(0, len(own), CHUNK):
        for k in range(sizes[lo : lo + CHUNK].max()):
            out[lo : lo + CHUNK] += best[members[lo : lo + CHUNK, k]]
    return out / sizes[:, None]


def _padded(values: np.ndarray, sizes: np.ndarray, fill: int = -1) -> np.ndarray:
    """Runs of ``sizes`` values as rows of a table, the rest of it ``fill``."""
    out = np.full((len(sizes), max(int(sizes.max()), 1) if len(sizes) else 1), fill)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _in_blocks(patient: DataFrame, profile: DataFrame, paths: pd.DataFrame, ic: pd.DataFrame, measure: str, k: int) -> DataFrame:
    """The k best of each block of profiles for each patient."""
    spark = patient.sparkSession
    ontology = spark.sparkContext.broadcast(_Ontology(paths, ic))  # MOST_PATHS pairs at most
    listed = lambda df, key: df.groupBy(F.col(key).alias("id")).agg(F.collect_list("term").alias("v"))

    def ready(side: list) -> list:
        sizes = [len(t) for t in side]
        return np.split(ontology.value.position(np.concatenate([np.asarray(t) for t in side])), np.cumsum(sizes)[:-1])

    def score(p: list, d: list) -> np.ndarray:
        o = ontology.value
        forth = [_directed(o, p, d[lo : lo + PROFILES], measure) for lo in range(0, len(d), PROFILES)]
        return (np.hstack(forth) + _directed(o, d, p, measure).T) / 2

    return best_in_blocks(listed(patient, "patient_id"), listed(profile, "disease_id"), score, k, PATIENT_BLOCK, PROFILE_BLOCK, chunk=PATIENTS, ready=ready)


def best_match_average(patient: DataFrame, profile: DataFrame, ancestors: DataFrame, ic: DataFrame, measure: str) -> DataFrame:
    """``patient_id, disease_id, score`` by joins on ancestors, for ontologies of any size.

    No pair of terms is made: a side's terms below an ancestor count by their least
    information content.  Pairs that share no ancestor are left out (their score is 0).
    """
    zero = lambda df, key: df.join(ic.withColumnRenamed("ic", "ic_t"), "term", "left").select(F.col(key).alias("id"), "term", F.coalesce("ic_t", F.lit(0.0)).alias("ic_t"))
    up = ancestors.join(ic.select(F.col("term").alias("ancestor"), F.col("ic").alias("ic_x")), "ancestor", "left").withColumn("ic_x", F.coalesce("ic_x", F.lit(0.0)))
    one, two = zero(patient, "patient_id").join(up, "term"), zero(profile, "disease_id").join(up, "term")

    def directed(own: DataFrame, other: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
        low = other.groupBy("id", "ancestor").agg(F.min("ic_t").alias("l"), F.min(F.when(F.col("ic_t") > 0, F.col("ic_t"))).alias("lp"))
        met = own.select("id", "term", "ancestor", "ic_x", F.col("ic_t").alias("ic_a")).join(low.withColumnRenamed("id", "other"), "ancestor")
        met = met.withColumn("ic_b", F.when(F.col("ic_a") > 0, F.col("l")).otherwise(F.coalesce("lp", "l"))) if measure == "lin" else met.withColumn("ic_b", F.col("l"))
        best = met.groupBy("id", "other", "term").agg(F.max(F.expr(MEASURES[measure])).alias("s")).groupBy("id", "other").agg(F.sum("s").alias("s"))
        return best.join(sizes.groupBy("id").agg(F.count("*").alias("n")), "id").select("id", "other", (F.col("s") / F.col("n")).alias(name))

    forth = directed(one, two, patient.select(F.col("patient_id").alias("id")), "forth").select(F.col("id").alias("patient_id"), F.col("other").alias("disease_id"), "forth")
    back = directed(two, one, profile.select(F.col("disease_id").alias("id")), "back").select(F.col("other").alias("patient_id"), F.col("id").alias("disease_id"), "back")
    return forth.join(back, ["patient_id", "disease_id"]).select("patient_id", "disease_id", ((F.col("forth") + F.col("back")) / 2).alias("score"))


def _front(two: DataFrame) -> DataFrame:
    """Of a profile's terms ``b`` below each ancestor those that can be a best match through it.

    Through one ancestor no measure grows with ``ic_b``, and of equal scores the
    least term wins: a term counts only if it is less than all that are at most as
    informative.  Where both sides have no information Lin is 0, so terms without any are
    held apart from the others.
    """
    order = Window.partitionBy("disease_id", "ancestor", F.col("ic_b") > 0).orderBy("ic_b", "b").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min("b").over(order)
    return two.withColumn("least_", least).where(F.col("least_").isNull() | (F.col("b") < F.col("least_"))).drop("least_")


def best_matches(pairs: DataFrame, patient: DataFrame, profile: DataFrame, ancestors: DataFrame, ic: DataFrame, measure: str) -> DataFrame:
    """The best term of the profile for each term of the patient, for given pairs.

    Columns patient_id, disease_id, term, best_term, mica, score; the last three
    are null, null and 0 for terms without a common ancestor.  Of equal scores the
    least term wins, then the most informative ancestor, then the greater id.
    """
    known = ic.select("term", F.col("ic").alias("t"))
    up = ancestors.join(ic.select(F.col("term").alias("ancestor"), F.col("ic").alias("ic_x")), "ancestor", "left").join(known, "term", "left")
    up = up.select("term", "ancestor", F.coalesce("ic_x", F.lit(0.0)).alias("ic_x"), F.coalesce("t", F.lit(0.0)).alias("t"))
    asked = pairs.join(patient, "patient_id")
    one = asked.join(up, "term").select("patient_id", "disease_id", "term", "ancestor", "ic_x", F.col("t").alias("ic_a"))
    two = profile.join(pairs.select("disease_id").distinct(), "disease_id", "left_semi").join(up.drop("ic_x"), "term").select("disease_id", "ancestor", F.col("term").alias("b"), F.col("t").alias("ic_b"))
    met = one.join(_front(two), ["disease_id", "ancestor"]).withColumn("sim", F.expr(MEASURES[measure]))
    order = F.struct(F.round("sim", DIGITS).alias("r"), (-F.col("b")).alias("nb"), F.round("ic_x", DIGITS).alias("ri"), "ancestor", "sim")
    best = met.groupBy("patient_id", "disease_id", "term").agg(F.max(order).alias("x"))
    best = best.select("patient_id", "disease_id", "term", (-F.col("x.nb")).alias("best_term"), F.col("x.ancestor").alias("mica"), F.col("x.sim").alias("score"))
    return asked.select("patient_id", "disease_id", "term").join(best, ["patient_id", "disease_id", "term"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def weak_matches(matches: DataFrame, ic: DataFrame, below: float = 0.3) -> DataFrame:
    """Terms whose best score is less than ``below``, with their information content."""
    weak = matches.where(F.round("score", DIGITS) < below).join(ic, "term", "left")
    return weak.select("patient_id", "disease_id", "term", "best_term", "mica", F.round("score", 4).alias("best_score"), F.round(F.coalesce("ic", F.lit(0.0)), 4).alias("ic"))


def clusters(matches: DataFrame, least: int = 2, top: int = 5) -> DataFrame:
    """Matches of a pair that go through one ancestor, if there are ``least`` of them; the best ``top`` by mean score."""
    found = matches.where("mica is not null").groupBy("patient_id", "disease_id", "mica").agg(
        F.count("*").alias("n_patient_terms"), F.count_distinct("best_term").alias("n_disease_terms"), F.avg("score").alias("s")
    ).where(F.col("n_patient_terms") >= least)
    best = ranked(found, ["patient_id", "disease_id"], [F.round("s", DIGITS).desc(), F.col("mica")]).where(F.col("rank") <= top)
    return best.select("patient_id", "disease_id", "rank", "mica", "n_patient_terms", "n_disease_terms", F.round("s", 4).alias("avg_score"))
