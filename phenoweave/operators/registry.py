"""Methods by name over one context of tables, and runs of many cases.

A method takes the context and ``patient_id, term`` and gives ``patient_id, rank,
disease_id, score``.  Users add their own with :func:`register`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import autoencoder, graph, ontology, semantic, sets, tfidf
from ..plans.ranking import top_k
from ..plans.session import dealt

Method = Callable[["Context", DataFrame], DataFrame]
METHODS: dict[str, Method] = {}
#: Methods that need more of the context than terms.
NEEDS: dict[str, tuple[str, ...]] = {}


@dataclass
class Context:
    """Tables that methods share; closure and information content are made when they are first asked for."""

    profile: DataFrame
    profile_term: DataFrame
    edge: DataFrame
    label: DataFrame | None = None
    text: DataFrame | None = None
    negative: DataFrame | None = None
    excluded: DataFrame | None = None
    least_ic: float | None = None
    k: int = 10
    made: dict = field(default_factory=dict)

    def once(self, name: str, make: Callable[[], DataFrame]):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    @property
    def ancestors(self) -> DataFrame:
        return self.once("ancestors", lambda: ontology.closure(self.edge, inclusive=True))

    @property
    def ic(self) -> DataFrame:
        return self.once("ic", lambda: ontology.information_content(self.profile_term, self.profile))


def register(name: str, *needs: str):
    def add(method: Method) -> Method:
        METHODS[name] = method
        NEEDS[name] = needs
        return method

    return add


for _m in sets.SCORES:
    register(_m)(lambda c, p, m=_m: sets.rank(p, c.profile_term, m, c.k))
for _m in semantic.MEASURES:
    register(f"semantic_{_m}_bma")(lambda c, p, m=_m: semantic.rank(p, c.profile_term, c.ancestors, c.ic, m, c.least_ic, c.k))


@register("set_jaccard_penalized", "negative", "excluded")
def _penalized(c: Context, p: DataFrame) -> DataFrame:
    scored = sets.penalized(p, c.profile_term, c.excluded, c.negative)
    return top_k(sets.with_zeros(scored, p, c.profile_term, c.k), ["patient_id"], c.k)


@register("tfidf_hpo")
def _tfidf_terms(c: Context, p: DataFrame) -> DataFrame:
    binary = lambda df, key: df.select(key, F.col("term").alias("token"), F.lit(1).alias("tf"))
    mine = binary(c.profile_term, "disease_id")
    weights = tfidf.idf(mine, mine, "disease_id")
    return top_k(tfidf.cosine(tfidf.weigh(binary(p, "patient_id"), weights), tfidf.weigh(mine, weights)), ["patient_id"], c.k)


def _labels(c: Context, terms: DataFrame, key: str) -> DataFrame:
    return tfidf.token_counts(dealt(terms.join(c.label, "term").select(key, "label"), key), key, "label")


def _label_method(c: Context, p: DataFrame, texts: bool) -> DataFrame:
    counts = tfidf.token_counts(c.text, "disease_id")
    weights = tfidf.idf(counts, c.profile, "disease_id")
    other = counts if texts else _labels(c, c.profile_term, "disease_id")
    asked = tfidf.weigh(_labels(c, ontology.ic_filter(p, c.ic, c.least_ic), "patient_id"), weights)
    return tfidf.rank(asked, tfidf.weigh(other, weights), weights, c.k)


register("tfidf_hybrid", "label", "text")(lambda c, p: _label_method(c, p, True))
register("tfidf_hpo_labels", "label", "text")(lambda c, p: _label_method(c, p, False))


@register("hpo2vec")
def _walked(c: Context, p: DataFrame) -> DataFrame:
    weight = c.once("weight", lambda: graph.weights(c.ic))
    vectors = c.once("vectors", lambda: graph.embed(graph.walks(graph.counted(c.edge, c.profile_term), weight)))
    return graph.rank(p, c.profile_term, vectors, weight, c.k)


def _encoded(c: Context, p: DataFrame, measure: str) -> DataFrame:
    model, terms = c.once("autoencoder", lambda: autoencoder.fit(c.profile_term))
    return autoencoder.rank(p, c.profile_term, model, terms, measure, c.k)


register("denoising_autoencoder")(lambda c, p: _encoded(c, p, "euclidean"))
register("denoising_autoencoder_batch")(lambda c, p: _encoded(c, p, "cosine"))


def check(methods: list[str], context: Context) -> list[str]:
    """The selected methods; ValueError if there are none, or one is unknown or lacks its tables."""
    if not methods:
        raise ValueError("no methods selected")
    for m in methods:
        if m not in METHODS:
            raise ValueError(f"unknown method {m}; known are {sorted(METHODS)}")
        missing = [n for n in NEEDS[m] if getattr(context, n) is None]
        if missing:
            raise ValueError(f"{m} needs {missing}")
    return list(dict.fromkeys(methods))


def resolve(name: str, known: list[str] | None = None) -> str:
    """A method by its exact name, by its name without case and marks, or as the only one that contains that."""
    known, plain = known or sorted(METHODS), lambda s: "".join(c for c in s.lower() if c.isalnum())
    if name in known:
        return name
    same = [k for k in known if plain(k) == plain(name)] or [k for k in known if plain(name) and plain(name) in plain(k)]
    if len(same) != 1:
        raise ValueError(f"{name!r} names {same or 'nothing'}")
    return same[0]


def allowed(names: list[str], present: list[str]) -> tuple[list[str], list[str]]:
    """Requested names as they are spelt in ``present``, whatever their case, and those that aren't there."""
    spelt = {p.lower(): p for p in present}
    return [spelt[n.lower()] for n in names if n.lower() in spelt], [n for n in names if n.lower() not in spelt]


def run(methods: list[str], context: Context, patients: DataFrame) -> DataFrame:
    """``patient_id, method, rank, disease_id, score`` of all selected methods; lazy."""
    out = None
    for m in check(methods, context):
        rows = METHODS[m](context, patients).select("patient_id", F.lit(m).alias("method"), "rank", "disease_id", F.col("score").cast("double").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def run_batch(methods: list[str], context: Context, cases: DataFrame, path: str, propagate: bool = False) -> dict[str, float]:
    """Rank the cases ``patient_id, term`` by each method and write one folder of rows for each; seconds by method.

    Cases that a method's folder has already aren't run again, so a stopped run goes on.
    """
    spark, seconds = cases.sparkSession, {}
    patients = ontology.propagate(cases, context.ancestors, "patient_id") if propagate else cases
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for m in check(methods, context):
        began, folder, todo = time.time(), f"{path}/method={m}", patients
        if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)):
            todo = patients.join(spark.read.parquet(folder).select("patient_id").distinct(), "patient_id", "left_anti")
        METHODS[m](context, todo).write.mode("append").parquet(folder)
        seconds[m] = round(time.time() - began, 3)
    return seconds


def timing_summary(seconds: dict[str, float]) -> list[tuple[str, float]]:
    """The slowest first."""
    return sorted(seconds.items(), key=lambda x: (-x[1], x[0]))
