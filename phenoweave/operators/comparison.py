"""Methods side by side: fusion with support, aliases in truth, and report tables.

Metric rows are ``label, system, dataset, recall_1, recall_10, mrr, seconds``; ``system``
is the kind of tool, ``label`` the method.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import DIGITS, ranked
from ..plans.session import cut
from . import evaluation, fusion

#: Kinds of methods in the order of reports, and what a name of the kind looks like; others are embeddings.
CATEGORIES = ("set", "semantic", "embedding", "tfidf", "hpo2vec", "autoencoder", "llm")
PATTERNS = (("set", "^set_"), ("semantic", "^semantic_"), ("tfidf", "tfidf"), ("hpo2vec", "^hpo2vec$"), ("autoencoder", "^denoising_autoencoder$"), ("llm", "(?i)mistral|ordo_llm$|^llm$"))
#: Least recall at 10 of the methods that the selective fusion takes.
LEAST_RECALL = 0.1


def category(method: Column) -> Column:
    out = F.when(method.rlike(PATTERNS[0][1]), PATTERNS[0][0])
    for name, pattern in PATTERNS[1:]:
        out = out.when(method.rlike(pattern), name)
    return out.otherwise("embedding")


def given_ranks(rows: DataFrame, k: int = 10) -> DataFrame:
    """``rows (case_id, method, disease_id, score, given)`` by their given rank where they have one, then by score.

    Ranks are numbered before rows without an id go, so these leave gaps.
    """
    order = [F.col("given").isNull(), F.col("given"), F.round("score", DIGITS).desc(), F.col("disease_id")]
    return ranked(rows, ["case_id", "method"], order).where((F.col("rank") <= k) & F.col("disease_id").isNotNull())


def fuse(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Consensus of all methods: score, methods, categories, best and worst rank; ties by best rank, then id."""
    fused = ranks.withColumn("category", category(F.col("method"))).groupBy("case_id", "disease_id").agg(
        F.round(F.sum(1.0 / (fusion.RRF_K + F.col("rank"))), 6).alias("score"), F.array_sort(F.collect_set("method")).alias("methods"),
        F.collect_set("category").alias("c"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"),
    )
    listed = F.filter(F.array(*[F.lit(c) for c in CATEGORIES]), lambda c: F.array_contains("c", c))
    fused = fused.withColumns({"categories": listed, "n_methods": F.size("methods"), "spread": F.col("worst_rank") - F.col("best_rank")}).drop("c")
    return ranked(fused, ["case_id"], [F.desc("score"), F.col("best_rank"), F.col("disease_id")]).where(F.col("rank") <= k)


def seriate(agreement: pd.DataFrame) -> list[str]:
    """Methods of a case's agreement rows ``method_a, method_b, jaccard``, similar ones side by side.

    The first axis of classical scaling; the matrix has a row for each method.
    """
    m = agreement.pivot(index="method_a", columns="method_b", values="jaccard").fillna(0.0).sort_index().sort_index(axis=1)
    n = len(m)
    if n < 3:
        return list(m.index)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (1 - m.to_numpy()) ** 2 @ centre)
    axis = vectors[:, -1] * np.sqrt(max(values[-1], 0))
    return [m.index[i] for i in np.argsort(axis, kind="stable")]


def comparison(ranks: DataFrame, k: int = 10) -> DataFrame:
    """One row for each case: its best candidate, how many methods there are, and their mean agreement."""
    best = fuse(ranks, 1).select("case_id", F.col("disease_id").alias("top_id"), F.col("score").alias("top_score"), F.col("n_methods").alias("top_methods"), "categories")
    pairs = fusion.agreement(ranks).where("method_a < method_b").groupBy("case_id").agg(F.round(F.avg("jaccard"), 5).alias("mean_agreement"))
    n = ranks.groupBy("case_id").agg(F.count_distinct("method").alias("n_methods"), F.count_distinct("disease_id").alias("n_candidates"))
    return n.join(best, "case_id").join(pairs, "case_id", "left")


# --- truth by aliases -------------------------------------------------------------------
def matched_ranks(ranks: DataFrame, truth: DataFrame, equal: DataFrame) -> DataFrame:
    """The rows of ``ranks`` whose id and a true one of their case have an equivalent in common (``id, other``)."""
    every = equal.unionByName(ranks.select(F.col("disease_id").alias("id")).unionByName(truth.select(F.col("disease_id").alias("id"))).distinct().withColumn("other", F.col("id"))).distinct()
    mine = ranks.select("disease_id").distinct().join(every, F.col("disease_id") == F.col("id")).select("disease_id", "other")
    theirs = truth.join(every, F.col("disease_id") == F.col("id")).select("case_id", "other").distinct()
    hit = ranks.join(mine, "disease_id").join(theirs, ["case_id", "other"], "left_semi")
    return hit.select(*ranks.columns).distinct()


def best_ranks(ranks: DataFrame, truth: DataFrame, equal: DataFrame) -> DataFrame:
    """``case_id, method, best_rank`` by aliases; null where nothing matches."""
    hits = matched_ranks(ranks, truth, equal).groupBy("case_id", "method").agg(F.min("rank").alias("best_rank"))
    return ranks.select("case_id", "method").distinct().join(hits, ["case_id", "method"], "left")


def distinct_truth(truth: DataFrame, equal: DataFrame) -> DataFrame:
    """``case_id, n_relevant``: true ids that are equivalent count once.

    Ids of one group have a least equivalent in common, as in a map from aliases
    to canonical ids.
    """
    least = equal.groupBy("id").agg(F.min("other").alias("least"))
    named = truth.join(least, truth["disease_id"] == least["id"], "left").withColumn("root", F.coalesce("least", "disease_id"))
    return named.groupBy("case_id").agg(F.count_distinct("root").alias("n_relevant"))


def code_ranks(rows: DataFrame, truth: DataFrame, separator: str = ";") -> DataFrame:
    """Best rank of results that carry several codes in one string, for ``case_id, method``."""
    codes = rows.withColumn("disease_id", F.explode(F.transform(F.split("codes", separator), F.trim)))
    hits = codes.join(truth, ["case_id", "disease_id"], "left_semi").groupBy("case_id", "method").agg(F.min("rank").alias("best_rank"))
    return rows.select("case_id", "method").distinct().join(hits, ["case_id", "method"], "left")


def align(best: DataFrame, methods: DataFrame) -> DataFrame:
    """Every case with every method: ``present`` says whether the method has the case."""
    grid = best.select("case_id").distinct().crossJoin(F.broadcast(methods.select("method").distinct()))  # a few methods
    return grid.join(best.withColumn("present", F.lit(True)), ["case_id", "method"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def evaluate(ranks: DataFrame, truth: DataFrame, equal: DataFrame, times: DataFrame, k: int = 10) -> DataFrame:
    """Metrics of all methods and of three fusions, in two passes.

    The second pass fuses all methods equally, by their recall at 10, and those of
    recall LEAST_RECALL or more (all, if none has it).
    """
    def scored(r: DataFrame) -> DataFrame:
        gain = matched_ranks(r, truth, equal).where(F.col("rank") <= k).groupBy("case_id", "method").agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
        ideal = F.expr(f"aggregate(sequence(1, CAST(least(n_relevant, {k}) AS INT)), 0D, (s, i) -> s + 1 / log2(i + 1D))")
        out = best_ranks(r, truth, equal).join(gain, ["case_id", "method"], "left").join(distinct_truth(truth, equal), "case_id", "left")
        return out.withColumn("ndcg", F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0))

    n = ranks.select("case_id").distinct().agg(F.count("*").alias("n"))  # one row
    hits = best_ranks(ranks, truth, equal).groupBy("method").agg(F.count_if(F.col("best_rank") <= 10).alias("hits"))
    recall = cut(hits.crossJoin(F.broadcast(n)).select("method", (F.col("hits") / F.col("n")).alias("weight")))  # a row for each method
    chosen = recall.where(F.col("weight") >= LEAST_RECALL)
    top = chosen if chosen.limit(1).count() else recall
    every = ranks.select("case_id", "method", "disease_id", "rank")
    variants = (("ensemble_rrf", ranks, None), ("ensemble_rrf_weighted", ranks, recall), ("ensemble_rrf_top", ranks.join(F.broadcast(top), "method", "left_semi"), None))
    for name, rows, weights in variants:
        fused = fusion.rrf(rows, None if weights is None else F.broadcast(weights), k)
        every = every.unionByName(fused.select("case_id", F.lit(name).alias("method"), "disease_id", "rank"))
    every = scored(cut(every))
    ndcg = every.groupBy("method").agg(F.round(F.avg("ndcg"), 4).alias("ndcg"))
    return evaluation.metrics(every).join(ndcg, "method").join(evaluation.timing(times).select("method", "avg_seconds"), "method", "left")


# --- report tables ----------------------------------------------------------------------
def best_pivot(metrics: DataFrame, datasets: list) -> DataFrame:
    """Greatest recall at 10 of each label on each dataset, a column each, by mean from the best on."""
    cells = metrics.groupBy("label").agg(*[F.max(F.when(F.col("dataset") == d, F.col("recall_10"))).alias(f"d{d}") for d in datasets])
    mean = F.array_compact(F.array(*[f"d{d}" for d in datasets]))
    return cells.withColumn("mean", F.round(F.aggregate(mean, F.lit(0.0), lambda s, x: s + x) / F.size(mean), 4))


def best_rows(metrics: DataFrame, by: str, keys: list[str], name: str = "label") -> DataFrame:
    """The row of greatest ``by`` for each ``keys``, ties by label."""
    return ranked(metrics, keys, [F.col(by).desc_nulls_last(), F.col(name)], "r_").where("r_ = 1").drop("r_")


def recall_curves(metrics: DataFrame, n: int = 5) -> DataFrame:
    """Recall at each cut of the ``n`` best methods of each dataset, in rows ``dataset, label, k, recall``."""
    top = ranked(metrics, ["dataset"], [F.col("recall_10").desc_nulls_last(), F.col("label")]).where(F.col("rank") <= n)
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in (1, 10)])).alias("x")
    return top.select("dataset", "label", cuts).select("dataset", "label", "x.k", "x.recall")


def speed(metrics: DataFrame) -> DataFrame:
    """Points of mean seconds and recall, for methods that were timed."""
    return metrics.where("seconds is not null").groupBy("label").agg(F.round(F.avg("seconds"), 3).alias("seconds"), F.round(F.avg("recall_10"), 4).alias("recall_10"))


def by_system(metrics: DataFrame, one: str, two: str) -> DataFrame:
    """Best recall of two kinds of systems on each dataset, and the first's lead."""
    best = metrics.groupBy("dataset").agg(*[F.max(F.when(F.col("system") == s, F.col("recall_10"))).alias(n) for s, n in ((one, "one"), (two, "two"))])
    return best.withColumn("lead", F.round(F.col("one") - F.col("two"), 4))


def family_means(metrics: DataFrame) -> DataFrame:
    """Mean recall at 10 of each family, single methods only."""
    return metrics.withColumn("family", category(F.col("label"))).groupBy("family").agg(F.round(F.avg("recall_10"), 4).alias("recall_10"), F.count("*").alias("n"))


def modal_system(metrics: DataFrame) -> DataFrame:
    """The commonest system of each label, ties by name."""
    n = metrics.groupBy("label", "system").agg(F.count("*").alias("n"))
    return ranked(n, ["label"], [F.desc("n"), F.col("system")], "r_").where("r_ = 1").select("label", "system")


def metric_table(metrics: DataFrame) -> DataFrame:
    """The metric rows with a flag on the best value of each column of a dataset."""
    w = Window.partitionBy("dataset")
    return metrics.withColumns({f"best_{c}": F.col(c) == F.max(c).over(w) for c in ("recall_1", "recall_10", "mrr")})


def flips(a: DataFrame, b: DataFrame, within: int = 10) -> DataFrame:
    """Cases that are hit within the cut in just one of two modes ``case_id, best_rank``."""
    hit = lambda df, n: df.select("case_id", F.coalesce(F.col("best_rank") <= within, F.lit(False)).alias(n))
    both = hit(a, "a").join(hit(b, "b"), "case_id", "full").na.fill(False, ["a", "b"])
    return both.where(F.col("a") != F.col("b")).select("case_id", F.when(F.col("a"), "first").otherwise("second").alias("only"))


def propagation_coverage(raw: DataFrame, propagated: DataFrame) -> DataFrame:
    """One row: profiles, those with propagated terms, those that propagation gave more terms."""
    n = raw.groupBy("disease_id").agg(F.count_distinct("term").alias("r")).join(propagated.groupBy("disease_id").agg(F.count_distinct("term").alias("p")), "disease_id", "full").na.fill(0)
    return n.agg(F.count("*").alias("n_profiles"), F.count_if(F.col("p") > 0).alias("n_propagated"), F.count_if(F.col("p") > F.col("r")).alias("n_expanded"))


def findings(metrics: DataFrame, single: DataFrame, ensembles: DataFrame) -> DataFrame:
    """Report sentences as rows ``question, subject, value``."""
    label = lambda df: df.groupBy("label").agg(F.round(F.avg("recall_10"), 4).alias("v"))
    top = lambda df, q, subject, value: df.orderBy(value if isinstance(value, Column) else F.desc(value), subject).limit(1).select(F.lit(q).alias("question"), F.col(subject).cast("string").alias("subject"), F.col("v").cast("double").alias("value"))
    best = single.groupBy("dataset").agg(F.max("recall_10").alias("v"))
    gain = best.withColumnRenamed("v", "s").join(ensembles.groupBy("dataset").agg(F.max("recall_10").alias("e")), "dataset").withColumn("v", F.col("e") - F.col("s"))
    slow = metrics.groupBy("label").agg(F.round(F.avg("seconds"), 3).alias("v")).where("v is not null")
    helped = gain.agg(F.lit("ensemble").alias("subject"), F.round(F.avg("v"), 4).alias("v"), F.count_if(F.col("v") > 0).alias("n"))
    rows = [
        top(label(single), "best method", "label", "v"), top(slow, "slowest method", "label", "v"), top(best, "hardest dataset", "dataset", F.col("v").asc()), top(best, "easiest dataset", "dataset", "v"),
        helped.select(F.lit("mean gain").alias("question"), "subject", F.col("v").alias("value")), helped.select(F.lit("datasets helped").alias("question"), "subject", F.col("n").cast("double").alias("value")),
        top(family_means(single).withColumnRenamed("recall_10", "v"), "best family", "family", "v"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# --- cells of imported tables -----------------------------------------------------------
def rank_cell(x: Column, most: int | None = None) -> Column:
    """A rank from a cell: whole part of a number; null for blanks, other text and ranks above ``most``."""
    n = F.floor(F.when(F.trim(x).rlike(r"^[+-]?\d+(\.\d*)?$"), F.trim(x)).cast("double")).cast("int")
    return n if most is None else F.when(n <= most, n)


def list_cell(x: Column) -> Column:
    """Items of a cell such as ``['a', 'b']``; any other text is one item, a blank none."""
    inner = F.regexp_extract(x, r"^\s*[\[(](.*)[\])]\s*$", 1)
    items = F.transform(F.split(inner, ","), lambda s: F.regexp_replace(F.trim(s), r"^['\"]|['\"]$", ""))
    listed = F.filter(items, lambda s: s != "")
    return F.when(x.rlike(r"^\s*[\[(].*[\])]\s*$"), listed).when(F.trim(x) != "", F.array(F.trim(x))).otherwise(F.array().cast("array<string>"))


def dataset_name(x: Column, names: dict[str, str] | None = None) -> Column:
    """Without the suffixes of result files, by ``names`` or in capitals."""
    y = F.regexp_replace(F.regexp_replace(x, r"\.(json|tsv)$", ""), r"_(summary|benchmarks?|results|evaluation)$", "")
    table = F.create_map(*[F.lit(v) for kv in (names or {"": ""}).items() for v in kv])
    return F.coalesce(table[F.lower(y)], F.upper(y))
