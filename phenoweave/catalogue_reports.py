"""Registered queries of reports, label texts and vector helpers; importing this completes the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _BEST, _IC, _INCLUSIVE, _RANKED_PAIRS, _RANKS, _TEXT, _TOP, _WEIGHTS, LEAST_IC, ORACLES, QUERIES, _best, _ic, _ranked_pairs, _text, _tokens_sql, query
from .operators import dense, evaluation, fusion, ontology, reports, semantic, sets, tfidf
from .plans.ranking import ranked
from .plans.session import dealt

__all__ = ["ORACLES", "QUERIES"]


# --- ontology ---------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {_INCLUSIVE}, pairs AS (SELECT DISTINCT x.term AS a, y.term AS b FROM patient_term x JOIN patient_term y ON x.patient_id = y.patient_id AND x.term < y.term)
    SELECT a, b, i.ancestor FROM pairs JOIN inclusive i ON i.term = a JOIN inclusive k ON k.term = b AND k.ancestor = i.ancestor""")
def common_ancestors(t):
    other = t.patient_term.select("patient_id", F.col("term").alias("b"))
    pairs = t.patient_term.withColumnRenamed("term", "a").join(other, "patient_id").where("a < b").select("a", "b").distinct()
    return semantic.common_ancestors(pairs, ontology.closure(t.edge, inclusive=True))


# --- text -------------------------------------------------------------------------------
_LABELS = "(SELECT {0}, label AS text FROM {1} JOIN term_label ON {1}.term = term_label.term)"
_PROFILE_IDF = f"""{_tokens_sql('disease_id', 'profile_text', 'dt')}, idf AS (SELECT token, ln(CAST((SELECT count(*) FROM profile) AS DOUBLE) / count(DISTINCT disease_id)) AS idf FROM dt GROUP BY 1),
    {_IC}, used AS (SELECT a.* FROM asked_term a JOIN ic USING (term) WHERE ic >= {LEAST_IC}), {_tokens_sql('patient_id', _LABELS.format('patient_id', 'used'), 'qt')},
    qw AS (SELECT patient_id, token, tf * idf AS w FROM qt JOIN idf USING (token))"""
_COSINE = f"""dn AS (SELECT disease_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), qn AS (SELECT patient_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
    scored AS (SELECT patient_id, disease_id, dot / (qn.n * dn.n) AS score FROM (SELECT patient_id, disease_id, sum(q.w * d.w) AS dot FROM qw q JOIN dw d USING (token) GROUP BY 1, 2)
      JOIN dn USING (disease_id) JOIN qn USING (patient_id) WHERE dn.n > 0 AND qn.n > 0) {_TOP.replace("round(score, 6)", "round(score, 5)")}"""


def _label_counts(t, terms, key: str):
    """Tokens of the labels of a key's terms; labels that repeat count again."""
    return tfidf.token_counts(dealt(terms.join(t.term_label, "term").select(key, "label"), key), key, "label")


def _asked_labels(t):
    """Weights of the profile texts' tokens, of profile texts, and of the label tokens of the patients' informative terms."""
    counts = tfidf.token_counts(t.profile_text, "disease_id")
    weights = tfidf.idf(counts, t.profile, "disease_id")
    used = ontology.ic_filter(t.asked_term, _ic(t), LEAST_IC)
    return weights, tfidf.weigh(counts, weights), tfidf.weigh(_label_counts(t, used, "patient_id"), weights)


def _rounded(best):
    return best.select("patient_id", "rank", "disease_id", F.round("score", 5).alias("score"))


@query(f"WITH {_tokens_sql('patient_id', _LABELS.format('patient_id', 'patient_term'), 'qt')} SELECT patient_id, token, tf FROM qt")
def label_tokens(t):
    return _label_counts(t, t.patient_term, "patient_id")


@query(f"WITH {_PROFILE_IDF}, {_tokens_sql('disease_id', _LABELS.format('disease_id', 'profile_term'), 'lt')}, dw AS (SELECT disease_id, token, tf * idf AS w FROM lt JOIN idf USING (token)), {_COSINE}")
def tfidf_label_topk(t):
    weights, _, asked = _asked_labels(t)
    return _rounded(tfidf.rank(asked, tfidf.weigh(_label_counts(t, t.profile_term, "disease_id"), weights), weights))


@query(f"WITH {_PROFILE_IDF}, dw AS (SELECT disease_id, token, tf * idf AS w FROM dt JOIN idf USING (token)), {_COSINE}")
def tfidf_hybrid_topk(t):
    weights, texts, asked = _asked_labels(t)
    return _rounded(tfidf.rank(asked, texts, weights))


@query(f"""WITH {_TEXT}, n AS (SELECT patient_id, count(*) AS n FROM qt GROUP BY 1)
    SELECT q.patient_id, d.disease_id, count(*) AS n_shared, round(count(*) / CAST(max(n) AS DOUBLE), 6) AS coverage FROM qt q JOIN dt d USING (token) JOIN n ON n.patient_id = q.patient_id GROUP BY 1, 2""")
def token_coverage(t):
    asked = tfidf.token_counts(t.query_text, "patient_id")
    n = asked.groupBy("patient_id").agg(F.count("*").alias("n"))
    shared = asked.select("patient_id", "token").join(tfidf.token_counts(t.doc, "disease_id"), "token").groupBy("patient_id", "disease_id").agg(F.count("*").alias("n_shared"))
    return shared.join(n, "patient_id").select("patient_id", "disease_id", "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("coverage"))


@query(f"""WITH {_TEXT} SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, token, round(part, 3) AS part FROM (
      SELECT *, row_number() OVER (PARTITION BY patient_id, disease_id ORDER BY round(part, 6) DESC, token) AS rank
      FROM (SELECT q.patient_id, d.disease_id, q.token, q.w * d.w AS part FROM qw q JOIN dw d USING (token))) WHERE rank <= 5""")
def contributing_tokens(t):
    _, _, docs, queries = _text(t)
    parts = queries.select("patient_id", "token", F.col("w").alias("q")).join(docs.select("disease_id", "token", F.col("w").alias("d")), "token").withColumn("part", F.col("q") * F.col("d"))
    best = ranked(parts, ["patient_id", "disease_id"], [F.round("part", 6).desc(), F.col("token")]).where("rank <= 5")
    return best.select("patient_id", "disease_id", "rank", "token", F.round("part", 3).alias("part"))


@query(f"""WITH {_RANKED_PAIRS}, {_IC}, {_tokens_sql('disease_id', 'profile_text', 'dt')}, {_tokens_sql('term', 'term_text', 'lt')}
    SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, term, round(ic, 4) AS ic FROM (
      SELECT h.*, coalesce(ic.ic, 0) AS ic, row_number() OVER (PARTITION BY patient_id, disease_id ORDER BY round(coalesce(ic.ic, 0), 9) DESC, h.term) AS rank
      FROM (SELECT DISTINCT b.patient_id, b.disease_id, p.term FROM best b JOIN asked_term p ON p.patient_id = b.patient_id JOIN lt ON lt.term = p.term JOIN dt ON dt.disease_id = b.disease_id AND dt.token = lt.token) h
      LEFT JOIN ic ON ic.term = h.term) WHERE rank <= 10""")
def contributing_terms(t):
    labels = tfidf.token_counts(t.term_label, "term", "label").select("term", "token")
    texts = tfidf.token_counts(t.profile_text, "disease_id").select("disease_id", "token")
    hit = _ranked_pairs(t).join(t.asked_term, "patient_id").join(labels, "term").join(texts, ["disease_id", "token"], "left_semi")
    return sets.top_terms(hit.select("patient_id", "disease_id", "term").distinct(), _ic(t), 10).withColumn("ic", F.round("ic", 4))


@query("SELECT conv_id, turn, sha256(coalesce(text, '')) AS hash FROM conversations")
def text_hash(t):
    return t.conversations.select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


# --- fusion and reports -----------------------------------------------------------------
@query(f"WITH {_RANKS} SELECT DISTINCT case_id, disease_id FROM ranks")
def candidate_pool(t):
    return reports.candidate_pool(fusion.rank_methods(t.ranked))


@query(f"""WITH {_BEST}, top AS (SELECT method FROM best GROUP BY 1 ORDER BY round(sum(coalesce(1.0 / best_rank, 0)) / count(*), 4) DESC, method LIMIT 3),
    f AS (SELECT case_id, disease_id, sum(1.0 / (60 + rank)) AS score, count(*) AS support, min(rank) AS best_rank, max(rank) AS worst_rank FROM ranks WHERE rank <= 10 AND method IN (SELECT method FROM top) GROUP BY 1, 2)
    SELECT case_id, CAST(r AS INTEGER) AS rank, disease_id, round(score, 6) AS score, support, best_rank, worst_rank, worst_rank - best_rank AS spread
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, disease_id) AS r FROM f) WHERE r <= 10""")
def rrf_top_methods(t):
    top = reports.top_methods(_best(t), 3).select("method")  # three rows
    return fusion.rrf(fusion.rank_methods(t.ranked).join(F.broadcast(top), "method", "left_semi"))


@query(f"WITH {_BEST} SELECT case_id, method, round(CASE WHEN best_rank <= 10 THEN 1 / log2(best_rank + 1.0) ELSE 0 END, 5) AS ndcg FROM best")
def ndcg_single_hit(t):
    return reports.single_hit_ndcg(_best(t))


@query(f"""WITH {_BEST} SELECT method, count(*) AS n_cases, count(best_rank) AS n_found, round(avg(best_rank), 4) AS mean_rank, median(best_rank) AS median_rank,
    round(avg(CASE WHEN best_rank <= 1 THEN 1.0 ELSE 0.0 END), 4) AS top_1, round(avg(CASE WHEN best_rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS top_10 FROM best GROUP BY 1""")
def benchmark_stats(t):
    return reports.benchmark_stats(_best(t))


@query(f"WITH {_BEST} SELECT case_id, " + ", ".join(f"min(best_rank) FILTER (method = '{m}') AS \"{m}\"" for m in _WEIGHTS) + " FROM best GROUP BY 1")
def rank_matrix_pivot(t):
    return reports.rank_matrix(_best(t), list(_WEIGHTS))


_SETS = f"""{_BEST}, scores AS (SELECT case_id % 7 AS dataset, method, count(*) AS n_cases, round(sum(coalesce(1.0 / best_rank, 0)) / count(*), 4) AS mrr,
    round(avg(CASE WHEN best_rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10 FROM best GROUP BY 1, 2)"""


def _scores(t):
    return reports.by_dataset(_best(t).withColumn("dataset", F.col("case_id") % 7))


@query(f"WITH {_SETS} SELECT dataset, arg_max(method, (recall_10, -ord)) AS method, max(recall_10) AS recall_10 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY method) AS ord FROM scores) GROUP BY 1")
def best_method_per_dataset(t):
    return reports.best_method(_scores(t))


@query(f"WITH {_SETS} SELECT dataset, round(avg(recall_10), 3) AS mean_recall, min(recall_10) AS least_recall, max(recall_10) AS greatest_recall FROM scores GROUP BY 1")
def dataset_difficulty(t):
    return reports.difficulty(_scores(t))


@query(f"""WITH {_SETS}, f AS (SELECT case_id, disease_id, sum(1.0 / (60 + rank)) AS score FROM ranks WHERE rank <= 10 GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, disease_id) AS r FROM f),
    h AS (SELECT c.case_id, min(o.r) AS best_rank FROM (SELECT DISTINCT case_id FROM ranks) c LEFT JOIN case_truth t ON t.case_id = c.case_id LEFT JOIN o ON o.case_id = c.case_id AND o.disease_id = t.disease_id AND o.r <= 10 GROUP BY 1),
    g AS (SELECT case_id % 7 AS dataset, round(avg(CASE WHEN best_rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS fused FROM h GROUP BY 1)
    SELECT dataset, fused, max(recall_10) AS single, round(fused - max(recall_10), 4) AS gain FROM g JOIN scores USING (dataset) GROUP BY 1, 2""")
def ensemble_gain(t):
    fused = fusion.rrf(fusion.rank_methods(t.ranked)).select("case_id", F.lit("rrf").alias("method"), "disease_id", "rank")
    best = evaluation.truth_ranks(fused, t.case_truth).withColumn("dataset", F.col("case_id") % 7)
    return reports.ensemble_gain(_scores(t), reports.by_dataset(best))


# --- dense vectors ----------------------------------------------------------------------
@query("""SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, round(e[d] / greatest(sqrt(list_dot_product(e, e)), 1e-12), 5) AS value
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) CROSS JOIN (SELECT unnest(range(1, 65)) AS d)""")
def l2_normalize(t):
    v = dense.l2_normalize(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")))
    return v.select("vec_id", F.posexplode("vector").alias("dim", "x")).select("vec_id", "dim", F.round("x", 5).alias("value"))
