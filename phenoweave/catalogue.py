"""Registered queries over the driver tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import Tables, with_tables
from .functions import identifiers
from .functions.text import STOPWORDS, is_negated, normalize_text, starts_of
from .operators import dense, evaluation, extraction, fusion, ontology, profiles, semantic, sets, tfidf
from .plans.ranking import top_k
from .plans.session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = with_tables(sql)
        return build
    return register


# --- set based scores -------------------------------------------------------------------
_PAIRS = """pairs AS (
    SELECT p.patient_id, d.disease_id, count(x.term) AS c, max(p.n) AS a, max(d.n) AS b
    FROM (SELECT patient_id, count(*) AS n FROM asked_term GROUP BY 1) p
    CROSS JOIN (SELECT disease_id, count(*) AS n FROM profile_term GROUP BY 1) d
    LEFT JOIN (SELECT patient_id, disease_id, q.term FROM asked_term q JOIN profile_term t ON q.term = t.term) x
      ON x.patient_id = p.patient_id AND x.disease_id = d.disease_id
    GROUP BY 1, 2)"""
_TOP = """SELECT patient_id, CAST(rank AS INTEGER) AS rank, disease_id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY round(score, 9) DESC, disease_id) AS rank FROM scored) WHERE rank <= 10"""
_SET_SQL = {
    "set_cosine": "c / sqrt(CAST(a AS DOUBLE) * b)", "set_jaccard": "CAST(c AS DOUBLE) / (a + b - c)",
    "set_dice": "2.0 * c / (a + b)", "set_overlap": "CAST(c AS DOUBLE) / least(a, b)",
}
for _m, _e in _SET_SQL.items():
    query(f"WITH {_PAIRS}, scored AS (SELECT patient_id, disease_id, CAST({_e} AS DOUBLE) AS score FROM pairs) {_TOP}", f"{_m}_topk")(
        lambda t, m=_m: sets.rank(t.asked_term, t.profile_term, m)
    )


@query(f"""WITH {_PAIRS}, clash AS (SELECT patient_id, disease_id, count(*) AS n FROM (
        SELECT e.patient_id, t.disease_id, e.term FROM asked_excluded e JOIN profile_term t ON e.term = t.term
        UNION SELECT p.patient_id, t.disease_id, p.term FROM asked_term p JOIN profile_negative t ON p.term = t.term) u GROUP BY 1, 2),
    scored AS (SELECT p.patient_id, p.disease_id, greatest(0.0, CAST(c AS DOUBLE) / (a + b - c) - 0.5 * coalesce(n, 0) / (a + b - c)) AS score
        FROM pairs p LEFT JOIN clash k ON p.patient_id = k.patient_id AND p.disease_id = k.disease_id)
    {_TOP}""")
def set_jaccard_penalized_topk(t):
    scored = sets.penalized(t.asked_term, t.profile_term, t.asked_excluded, t.profile_negative)
    return top_k(sets.with_zeros(scored, t.asked_term, t.profile_term, 10), ["patient_id"], 10).select("patient_id", "rank", "disease_id", F.round("score", 6).alias("score"))


@query("""WITH pairs AS (SELECT p.patient_id, d.disease_id, count(*) AS c FROM patient_term p JOIN profile_term d ON p.term = d.term GROUP BY 1, 2),
    np AS (SELECT patient_id, CAST(count(*) AS DOUBLE) AS a FROM patient_term GROUP BY 1), nd AS (SELECT disease_id, CAST(count(*) AS DOUBLE) AS b FROM profile_term GROUP BY 1)
    SELECT patient_id, disease_id, c AS matched, CAST(a - c AS BIGINT) AS unmatched_patient, CAST(b - c AS BIGINT) AS unmatched_disease,
    round(c / a, 6) AS patient_coverage, round(c / b, 6) AS disease_coverage, round(abs(c / a - c / b), 6) AS asymmetry
    FROM pairs JOIN np USING (patient_id) JOIN nd USING (disease_id)""")
def coverage_block(t):
    return sets.coverage(t.patient_term, t.profile_term)


@query("""WITH x AS (SELECT e.patient_id, n.disease_id, count(*) AS k FROM patient_excluded e JOIN profile_term n ON e.term = n.term GROUP BY 1, 2),
    y AS (SELECT p.patient_id, n.disease_id, count(*) AS k FROM patient_term p JOIN profile_negative n ON p.term = n.term GROUP BY 1, 2)
    SELECT coalesce(x.patient_id, y.patient_id) AS patient_id, coalesce(x.disease_id, y.disease_id) AS disease_id,
      coalesce(x.k, 0) AS excluded_in_disease, coalesce(y.k, 0) AS negative_in_patient
    FROM x FULL JOIN y ON x.patient_id = y.patient_id AND x.disease_id = y.disease_id""")
def exclusion_conflicts(t):
    return sets.conflicts(t.patient_term, t.profile_term, t.patient_excluded, t.profile_negative)


_IC = "ic AS (SELECT term, -ln(CAST(count(DISTINCT disease_id) AS DOUBLE) / (SELECT count(*) FROM profile)) AS ic FROM profile_term GROUP BY 1)"


def _ic(t):
    return ontology.information_content(t.profile_term, t.profile)



def _top_terms(join: str, n: int) -> str:
    return f"""WITH {_IC}, shared AS ({join}) SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, term, round(ic, 6) AS ic FROM (
        SELECT s.*, coalesce(ic, 0) AS ic, row_number() OVER (PARTITION BY patient_id, disease_id ORDER BY round(coalesce(ic, 0), 9) DESC, s.term) AS rank
        FROM shared s LEFT JOIN ic ON s.term = ic.term) WHERE rank <= {n}"""


@query(_top_terms("SELECT patient_id, disease_id, p.term FROM patient_term p JOIN profile_term d ON p.term = d.term", 15))
def matched_terms_topn(t):
    return sets.matched_terms(t.patient_term, t.profile_term, _ic(t), 15)


_RANKED_PAIRS = f"""{_PAIRS}, scored AS (SELECT patient_id, disease_id, {_SET_SQL['set_jaccard']} AS score FROM pairs), best AS ({_TOP})"""


def _ranked_pairs(t):
    """The profiles that Jaccard ranks for the patients that ask, made once."""
    return cut(sets.rank(t.asked_term, t.profile_term, "set_jaccard").select("patient_id", "disease_id"))


@query(f"""WITH {_RANKED_PAIRS}, {_IC} SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, term, round(ic, 6) AS ic FROM (
    SELECT c.patient_id, c.disease_id, p.term, coalesce(ic.ic, 0) AS ic, row_number() OVER (PARTITION BY c.patient_id, c.disease_id ORDER BY round(coalesce(ic.ic, 0), 9) DESC, p.term) AS rank
    FROM best c JOIN asked_term p ON p.patient_id = c.patient_id LEFT JOIN ic ON ic.term = p.term
    WHERE NOT EXISTS (SELECT 1 FROM profile_term d WHERE d.disease_id = c.disease_id AND d.term = p.term)) WHERE rank <= 10""")
def unmatched_terms_topn(t):
    rest = _ranked_pairs(t).join(t.asked_term, "patient_id").join(t.profile_term, ["disease_id", "term"], "left_anti")
    return sets.top_terms(rest, _ic(t), 10)


@query(f"WITH {_IC} SELECT patient_id, disease_id, count(*) AS n_shared, round(sum(coalesce(ic, 0)), 5) AS ic_sum FROM patient_term p JOIN profile_term d ON p.term = d.term LEFT JOIN ic ON ic.term = p.term GROUP BY 1, 2")
def ic_quality(t):
    return sets.ic_quality(t.patient_term, t.profile_term, _ic(t))


# --- ontology ---------------------------------------------------------------------------
_CLOSURE = "closure AS (SELECT child AS term, parent AS ancestor FROM edge UNION SELECT c.term, e.parent FROM closure c JOIN edge e ON e.child = c.ancestor)"
_INCLUSIVE = f"{_CLOSURE}, inclusive AS (SELECT * FROM closure UNION SELECT child, child FROM edge UNION SELECT parent, parent FROM edge)"


@query(f"WITH RECURSIVE {_CLOSURE} SELECT term, ancestor FROM closure")
def ancestor_closure(t):
    return ontology.closure(t.edge)


@query(f"WITH RECURSIVE {_INCLUSIVE} SELECT term, ancestor FROM inclusive")
def inclusive_closure(t):
    return ontology.closure(t.edge, inclusive=True)


@query(f"WITH RECURSIVE {_CLOSURE} SELECT patient_id, term FROM patient_term UNION SELECT patient_id, ancestor FROM patient_term p JOIN closure c ON c.term = p.term")
def propagate_terms(t):
    return ontology.propagate_lists(t.patient_term, ontology.ancestor_lists(t.edge), "patient_id")


@query("SELECT term, count(DISTINCT disease_id) AS df FROM profile_term GROUP BY 1")
def term_document_frequency(t):
    return ontology.document_frequency(t.profile_term)


@query(f"WITH {_IC} SELECT term, round(ic, 6) AS ic FROM ic")
def information_content(t):
    return _ic(t).select("term", F.round("ic", 6).alias("ic"))


@query(f"WITH {_IC} SELECT p.patient_id, p.term FROM patient_term p LEFT JOIN ic ON ic.term = p.term WHERE coalesce(ic, 0) >= 1.7")
def ic_filter(t):
    return ontology.ic_filter(t.patient_term, _ic(t), 1.7)


_CHAIN = f"""{_CLOSURE}, size AS (SELECT term, count(*) AS n FROM closure GROUP BY 1),
    step AS (SELECT child AS term, parent FROM (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY coalesce(n, 0), parent) AS r FROM edge LEFT JOIN size ON term = parent) WHERE r = 1),
    chain AS (SELECT term, 1 AS depth, parent AS ancestor FROM step UNION ALL SELECT c.term, depth + 1, s.parent FROM chain c JOIN step s ON s.term = c.ancestor WHERE s.parent <> c.term)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT term, depth, ancestor FROM chain")
def ancestor_chain(t):
    return ontology.ancestor_chain(t.edge, ontology.closure(t.edge))


@query(f"WITH RECURSIVE {_CHAIN} SELECT c.term, depth, ancestor, coalesce(label, CAST(ancestor AS VARCHAR)) AS label FROM chain c LEFT JOIN term_label l ON l.term = c.ancestor WHERE depth <= 5")
def category_path(t):
    return ontology.category_path(ontology.ancestor_chain(t.edge, ontology.closure(t.edge)), t.term_label)


# --- semantic scores --------------------------------------------------------------------
LEAST_IC = 1.7
_MICA = f"""{_INCLUSIVE}, {_IC}, pairs AS (SELECT DISTINCT x.term AS a, y.term AS b FROM patient_term x JOIN patient_term y ON x.patient_id = y.patient_id AND x.term < y.term)"""


@query(f"""WITH RECURSIVE {_MICA} SELECT a, b, mica, round(ic, 6) AS ic_mica FROM (
    SELECT a, b, x.ancestor AS mica, coalesce(ic.ic, 0) AS ic, row_number() OVER (PARTITION BY a, b ORDER BY round(coalesce(ic.ic, 0), 9) DESC, x.ancestor DESC) AS r
    FROM pairs JOIN inclusive x ON x.term = a JOIN inclusive y ON y.term = b AND y.ancestor = x.ancestor LEFT JOIN ic ON ic.term = x.ancestor) WHERE r = 1""")
def mica_pairs(t):
    other = t.patient_term.select("patient_id", F.col("term").alias("b"))
    pairs = t.patient_term.withColumnRenamed("term", "a").join(other, "patient_id").where("a < b").select("a", "b").distinct()
    return semantic.mica(pairs, ontology.closure(t.edge, inclusive=True), _ic(t)).select("a", "b", "mica", F.round("ic_mica", 6).alias("ic_mica"))


_SIM = {
    "resnik": "x_ic", "lin": "CASE WHEN ia + ib > 0 THEN 2 * x_ic / (ia + ib) ELSE 0 END",
    "jiang_conrath": "1 / (1 + greatest(0, ia + ib - 2 * x_ic))",
}


def _bma_sql(measure: str) -> str:
    """Similarity through every common ancestor; the best one is that of the most informative."""
    return f"""WITH RECURSIVE {_INCLUSIVE}, {_IC}, pt AS (SELECT q.* FROM asked_term q JOIN ic USING (term) WHERE ic >= {LEAST_IC}), dt AS (SELECT q.* FROM profile_term q JOIN ic USING (term) WHERE ic >= {LEAST_IC}),
        up AS (SELECT i.term, i.ancestor, s.ic AS t_ic, coalesce(x.ic, 0) AS x_ic FROM inclusive i JOIN ic s ON s.term = i.term LEFT JOIN ic x ON x.term = i.ancestor),
        sim AS (SELECT a, b, max({_SIM[measure]}) AS sim FROM (SELECT p.term AS a, d.term AS b, p.t_ic AS ia, d.t_ic AS ib, p.x_ic FROM up p JOIN up d ON p.ancestor = d.ancestor
          WHERE p.term IN (SELECT term FROM pt) AND d.term IN (SELECT term FROM dt)) GROUP BY 1, 2),
        j AS (SELECT p.patient_id, d.disease_id, a, b, sim FROM pt p JOIN sim ON a = p.term JOIN dt d ON b = d.term),
        f AS (SELECT patient_id, disease_id, sum(s) AS s FROM (SELECT patient_id, disease_id, a, max(sim) AS s FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2),
        g AS (SELECT patient_id, disease_id, sum(s) AS s FROM (SELECT patient_id, disease_id, b, max(sim) AS s FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2),
        scored AS (SELECT u.patient_id, v.disease_id, (coalesce(f.s, 0) / np + coalesce(g.s, 0) / nd) / 2 AS score
          FROM (SELECT patient_id, count(*) AS np FROM pt GROUP BY 1) u CROSS JOIN (SELECT disease_id, count(*) AS nd FROM dt GROUP BY 1) v
          LEFT JOIN f ON f.patient_id = u.patient_id AND f.disease_id = v.disease_id LEFT JOIN g ON g.patient_id = u.patient_id AND g.disease_id = v.disease_id)
        {_TOP.replace("round(score, 6)", "round(score, 5)")}"""


for _m in _SIM:
    def _bma(t, m=_m):
        return semantic.rank(t.asked_term, t.profile_term, ontology.closure(t.edge, inclusive=True), _ic(t), m, LEAST_IC)

    # of all patients and profiles the SQL makes each pair of terms: too slow on whole tables, tests compare on sf0.001
    query(_bma_sql(_m), f"{_m}_bma_topk")(_bma)

_MATCHES = f"""{_RANKED_PAIRS}, {_INCLUSIVE}, {_IC},
    up AS (SELECT i.term, i.ancestor, coalesce(s.ic, 0) AS t_ic, coalesce(x.ic, 0) AS x_ic FROM inclusive i LEFT JOIN ic s ON s.term = i.term LEFT JOIN ic x ON x.term = i.ancestor),
    through AS (SELECT c.patient_id, c.disease_id, p.term AS a, d.term AS b, x.ancestor, x.x_ic, x.t_ic AS ia, y.t_ic AS ib
      FROM best c JOIN asked_term p ON p.patient_id = c.patient_id JOIN up x ON x.term = p.term JOIN profile_term d ON d.disease_id = c.disease_id JOIN up y ON y.term = d.term AND y.ancestor = x.ancestor),
    matched AS (SELECT * FROM (SELECT patient_id, disease_id, a, b, ancestor AS mica, sim, row_number() OVER (PARTITION BY patient_id, disease_id, a ORDER BY round(sim, 9) DESC, b, round(x_ic, 9) DESC, ancestor DESC) AS r
      FROM (SELECT *, {_SIM['lin']} AS sim FROM through)) WHERE r = 1)"""


def _matches(t):
    return semantic.best_matches(_ranked_pairs(t), t.asked_term, t.profile_term, ontology.closure(t.edge, inclusive=True), _ic(t), "lin")


@query(f"""WITH RECURSIVE {_MATCHES} SELECT c.patient_id, c.disease_id, p.term, b AS best_term, mica, round(coalesce(sim, 0), 4) AS best_score, round(coalesce(ic.ic, 0), 4) AS ic
    FROM best c JOIN asked_term p ON p.patient_id = c.patient_id LEFT JOIN matched m ON m.patient_id = c.patient_id AND m.disease_id = c.disease_id AND m.a = p.term LEFT JOIN ic ON ic.term = p.term
    WHERE round(coalesce(sim, 0), 9) < 0.95""")
def weak_matches(t):
    return semantic.weak_matches(_matches(t), _ic(t), 0.95)  # information content varies little in these tables


@query(f"""WITH RECURSIVE {_MATCHES} SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, mica, n_patient_terms, n_disease_terms, round(score, 4) AS avg_score FROM (
    SELECT *, row_number() OVER (PARTITION BY patient_id, disease_id ORDER BY round(score, 9) DESC, mica) AS rank FROM (
      SELECT patient_id, disease_id, mica, count(*) AS n_patient_terms, count(DISTINCT b) AS n_disease_terms, avg(sim) AS score FROM matched GROUP BY 1, 2, 3 HAVING count(*) >= 2)) WHERE rank <= 5""")
def semantic_clusters(t):
    return semantic.clusters(_matches(t))


# --- text -------------------------------------------------------------------------------
def _tokens_sql(key: str, table: str, out: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"{out} AS (SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS token FROM {table}) WHERE length(token) >= 3 AND token NOT IN ({stop}) GROUP BY 1, 2)"


_TEXT = f"""{_tokens_sql('disease_id', 'doc', 'dt')}, {_tokens_sql('patient_id', 'query_text', 'qt')},
    asking AS (SELECT * FROM qt WHERE patient_id % 20 = 0),
    idf AS (SELECT token, ln(CAST((SELECT count(DISTINCT disease_id) FROM doc) AS DOUBLE) / count(DISTINCT disease_id)) AS idf FROM dt GROUP BY 1),
    dw AS (SELECT disease_id, token, tf * idf AS w FROM dt JOIN idf USING (token)), qw AS (SELECT patient_id, token, tf * idf AS w FROM asking JOIN idf USING (token))"""


def _text(t):
    counts = tfidf.token_counts(t.doc, "disease_id")
    weights = tfidf.idf(counts, t.doc, "disease_id")
    return counts, weights, tfidf.weigh(counts, weights), tfidf.weigh(tfidf.token_counts(t.asked_text, "patient_id"), weights)


def _placed_text(t):
    """Weights of tokens, and norms of documents whose tokens aren't sent."""
    counts = tfidf.token_counts(t.doc, "disease_id", whole=True)
    weights = cut(tfidf.idf(counts, t.doc, "disease_id", once=True))
    return weights, tfidf.norms_in_place(counts, weights, "disease_id")


@query(f"WITH {_TEXT} SELECT disease_id, token, tf FROM dt")
def tokenize_counts(t):
    return tfidf.token_counts(t.doc, "disease_id")


@query(f"WITH {_TEXT} SELECT token, round(idf, 6) AS idf FROM idf")
def text_idf(t):
    return _text(t)[1].select("token", F.round("idf", 6).alias("idf"))


@query(f"WITH {_TEXT} SELECT disease_id, round(sqrt(sum(w * w)), 4) AS norm FROM dw GROUP BY 1")
def vector_norms(t):
    return _placed_text(t)[1].select("disease_id", F.round("norm", 4).alias("norm"))


@query(f"""WITH {_TEXT}, dn AS (SELECT disease_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), qn AS (SELECT patient_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
    scored AS (SELECT patient_id, disease_id, dot / (qn.n * dn.n) AS score FROM (SELECT patient_id, disease_id, sum(q.w * d.w) AS dot FROM qw q JOIN dw d USING (token) GROUP BY 1, 2)
      JOIN dn USING (disease_id) JOIN qn USING (patient_id) WHERE dn.n > 0 AND qn.n > 0) {_TOP.replace("round(score, 6)", "round(score, 5)")}""")
def tfidf_text_topk(t):
    weights, lengths = _placed_text(t)
    queries = tfidf.sent(tfidf.weigh(tfidf.token_counts(t.asked_text, "patient_id"), weights.drop("df")))
    used = tfidf.sent(queries.select("token", "idf").distinct())
    docs = tfidf.weigh(tfidf.token_counts(t.doc, "disease_id", whole=True, only=used), used)
    return top_k(tfidf.cosine(queries, docs, lengths), ["patient_id"], 10).select("patient_id", "rank", "disease_id", F.round("score", 5).alias("score"))


@query(f"WITH {_TEXT} SELECT q.patient_id, q.token, round(idf, 4) AS idf FROM qt q JOIN idf USING (token) WHERE round(idf, 4) < 2.5")
def low_idf_matches(t):
    w = _text(t)[1].withColumn("idf", F.round("idf", 4)).where("idf < 2.5")
    return tfidf.token_counts(t.query_text, "patient_id").join(w, "token").select("patient_id", "token", "idf")


@query("""WITH idf AS (SELECT term, ln(CAST((SELECT count(DISTINCT disease_id) FROM profile_term) AS DOUBLE) / count(DISTINCT disease_id)) AS idf FROM profile_term GROUP BY 1),
    dn AS (SELECT disease_id, sqrt(sum(idf * idf)) AS n FROM profile_term JOIN idf USING (term) GROUP BY 1), qn AS (SELECT patient_id, sqrt(sum(idf * idf)) AS n FROM asked_term JOIN idf USING (term) GROUP BY 1),
    scored AS (SELECT patient_id, disease_id, dot / (qn.n * dn.n) AS score FROM (SELECT patient_id, disease_id, sum(idf * idf) AS dot FROM asked_term JOIN profile_term USING (term) JOIN idf USING (term) GROUP BY 1, 2)
      JOIN dn USING (disease_id) JOIN qn USING (patient_id) WHERE dn.n > 0 AND qn.n > 0) """ + _TOP)
def tfidf_hpo_topk(t):
    binary = lambda df, key: df.select(key, F.col("term").alias("token"), F.lit(1).alias("tf"))
    profile = binary(t.profile_term, "disease_id")
    weights = tfidf.idf(profile, profile, "disease_id")
    scored = tfidf.cosine(tfidf.weigh(binary(t.asked_term, "patient_id"), weights), tfidf.weigh(profile, weights))
    return top_k(scored, ["patient_id"], 10).select("patient_id", "rank", "disease_id", F.round("score", 6).alias("score"))


# --- profiles ---------------------------------------------------------------------------
@query("""SELECT disease_id, term, arg_max(source_priority, o) FILTER (pos) AS source_priority, arg_max(frequency_rank, o) FILTER (pos) AS frequency_rank, arg_max(ord, o) FILTER (pos) AS ord,
      count(DISTINCT source_priority) AS n_sources, bool_or(NOT pos) AS has_negative, count(*) FILTER (pos) = 0 AS negative_term
    FROM (SELECT *, coalesce(qualifier <> 'NOT', true) AS pos, (source_priority, frequency_rank, -ord) AS o FROM annotation) GROUP BY 1, 2""")
def merge_annotations(t):
    return profiles.merge_annotations(t.annotation)


@query("SELECT disease_id, term FROM annotation GROUP BY 1, 2 HAVING count(*) FILTER (coalesce(qualifier <> 'NOT', true)) = 0")
def negative_terms(t):
    return profiles.merge_annotations(t.annotation).where("negative_term").select("disease_id", "term")


@query("SELECT source_priority, count(*) AS n FROM annotation GROUP BY ROLLUP (source_priority)")
def source_counts(t):
    return profiles.source_counts(t.annotation)


@query("SELECT DISTINCT coalesce(canonical_id, disease_id) AS disease_id, term FROM profile_term LEFT JOIN alias ON alias_id = disease_id")
def canonical_profiles(t):
    return profiles.canonical_profiles(t.profile_term, t.alias)


@query("""WITH c AS (SELECT DISTINCT coalesce(canonical_id, disease_id) AS disease_id, term FROM profile_term LEFT JOIN alias ON alias_id = disease_id)
    SELECT disease_id, term, disease_id AS canonical_id FROM c UNION ALL SELECT alias_id, term, canonical_id FROM c JOIN alias ON canonical_id = disease_id WHERE alias_id <> canonical_id""")
def alias_expansion(t):
    return profiles.expand_aliases(profiles.canonical_profiles(t.profile_term, t.alias), t.alias)


@query("SELECT l_partkey AS id, arg_max(l_suppkey, (l_linenumber, l_orderkey, l_suppkey)) AS target FROM lineitem GROUP BY 1")
def mapping_index(t):
    return profiles.mapping_index(t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("source_ord"), F.col("l_orderkey").alias("row_ord")))


_RAW_IDS = "CASE c_custkey % 8 WHEN 0 THEN 'Orphanet_' || c_custkey WHEN 1 THEN 'MONDO_' || c_custkey WHEN 2 THEN ' MIM:' || c_custkey WHEN 3 THEN 'http://x.org/Orphanet_' || c_custkey || '/' WHEN 4 THEN CAST(c_custkey AS VARCHAR(20)) WHEN 5 THEN 'ORPHANET:' || c_custkey WHEN 6 THEN ' ' ELSE 'other-' || c_custkey END"


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'ORPHA:' || c_custkey WHEN 1 THEN 'MONDO:' || c_custkey WHEN 2 THEN 'OMIM:' || c_custkey WHEN 3 THEN 'ORPHA:' || c_custkey
    WHEN 4 THEN 'ORPHA:' || c_custkey WHEN 5 THEN 'ORPHA:' || c_custkey WHEN 6 THEN NULL ELSE 'other-' || c_custkey END AS id FROM customer""")
def normalize_ids(t):
    return t.customer.select("c_custkey", identifiers.normalize_disease_id(F.expr(_RAW_IDS)).alias("id"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'VERY_RARE' WHEN 1 THEN 'OBLIGATE' WHEN 2 THEN 'VERY_FREQUENT' WHEN 3 THEN 'EXCLUDED' WHEN 4 THEN NULL ELSE '1/2' END AS frequency FROM part""")
def normalize_frequency(t):
    raw = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'vr' WHEN 1 THEN 'Obligate (100%)' WHEN 2 THEN 'Very frequent (99-80%)' WHEN 3 THEN '0%' WHEN 4 THEN '  ' ELSE ' 1/2 ' END")
    return t.part.select("p_partkey", identifiers.normalize_frequency(raw).alias("frequency"))


@query("SELECT count(*) AS n_before, count(*) FILTER (regexp_matches(coalesce(text, ''), '\\S')) AS n_after FROM documents")
def valid_profiles(t):
    return t.documents.agg(F.count("*").alias("n_before"), F.count_if(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\S"))).alias("n_after"))


# --- fusion -----------------------------------------------------------------------------
_RANKS = "ranks AS (SELECT case_id, method, disease_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id, method ORDER BY round(score, 9) DESC, disease_id) AS r FROM ranked) WHERE r <= 10)"


def _rrf_sql(weight: str) -> str:
    return f"""WITH {_RANKS}, f AS (SELECT case_id, disease_id, sum({weight} / (60 + rank)) AS score, count(*) AS support, min(rank) AS best_rank, max(rank) AS worst_rank FROM ranks WHERE {weight} <> 0 GROUP BY 1, 2)
        SELECT case_id, CAST(r AS INTEGER) AS rank, disease_id, round(score, 6) AS score, support, best_rank, worst_rank, worst_rank - best_rank AS spread
        FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, disease_id) AS r FROM f) WHERE r <= 10"""


@query(_rrf_sql("1.0"))
def rrf_equal(t):
    return fusion.rrf(fusion.rank_methods(t.ranked))


_WEIGHTS = {"view": 1.0, "click": 2.0, "error": 0.0, "purchase": 0.5, "signup": 1.5}


@query(_rrf_sql("(CASE method " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _WEIGHTS.items()) + " END)"))
def rrf_weighted(t):
    weights = t.spark.createDataFrame(list(_WEIGHTS.items()), "method string, weight double")
    return fusion.rrf(fusion.rank_methods(t.ranked), F.broadcast(weights))


@query(f"""WITH {_RANKS}, z AS (SELECT case_id, method, count(*) AS n FROM ranks GROUP BY 1, 2),
    c AS (SELECT a.case_id, a.method AS ma, b.method AS mb, count(*) AS c FROM ranks a JOIN ranks b ON a.case_id = b.case_id AND a.disease_id = b.disease_id GROUP BY 1, 2, 3)
    SELECT x.case_id, x.method AS method_a, y.method AS method_b, round(coalesce(c, 0) / CAST(x.n + y.n - coalesce(c, 0) AS DOUBLE), 6) AS jaccard
    FROM z x JOIN z y ON x.case_id = y.case_id LEFT JOIN c ON c.case_id = x.case_id AND ma = x.method AND mb = y.method""")
def agreement_jaccard(t):
    return fusion.agreement(fusion.rank_methods(t.ranked))


@query("""SELECT case_id, method, coalesce(canonical_id, disease_id) AS canonical_id, arg_min(disease_id, (-round(score, 9), disease_id)) AS best_alias, round(max(round(score, 9)), 6) AS score, count(*) AS n_aliases
    FROM ranked LEFT JOIN alias ON alias_id = disease_id GROUP BY 1, 2, 3""")
def canonical_collapse(t):
    return fusion.collapse(t.ranked, t.alias)


@query(f"WITH {_RANKS} SELECT case_id, disease_id, count(*) AS n_methods, round(avg(score), 5) AS avg_score, round(avg(rank), 5) AS avg_rank, min(rank) AS best_rank FROM ranks GROUP BY 1, 2")
def cooccurrence_summary(t):
    return fusion.cooccurrence(fusion.rank_methods(t.ranked))


@query(f"WITH {_RANKS} SELECT case_id, disease_id, " + ", ".join(f"min(rank) FILTER (method = '{m}') AS \"{m}\"" for m in _WEIGHTS) + " FROM ranks GROUP BY 1, 2")
def best_rank_by_category(t):
    return fusion.best_rank_pivot(fusion.rank_methods(t.ranked), list(_WEIGHTS))


@query(f"WITH {_RANKS} SELECT case_id, method, disease_id, score, rank FROM ranks")
def limit_per_method(t):
    return fusion.rank_methods(t.ranked)


# --- evaluation -------------------------------------------------------------------------
_BEST = f"""{_RANKS.replace("r <= 10", "r <= 50")}, best AS (SELECT m.case_id, m.method, h.best_rank FROM (SELECT DISTINCT case_id, method FROM ranks) m
    LEFT JOIN (SELECT r.case_id, r.method, min(rank) AS best_rank FROM ranks r JOIN case_truth t ON t.case_id = r.case_id AND t.disease_id = r.disease_id GROUP BY 1, 2) h ON h.case_id = m.case_id AND h.method = m.method)"""


def _best(t):
    return evaluation.truth_ranks(fusion.rank_methods(t.ranked, 50), t.case_truth)


@query(f"WITH {_BEST} SELECT case_id, method, best_rank FROM best")
def best_truth_rank(t):
    return _best(t)


@query(f"WITH {_BEST} SELECT method, count(*) AS n_cases, count(best_rank) AS n_found, " + ", ".join(f"round(avg(CASE WHEN best_rank <= {k} THEN 1.0 ELSE 0.0 END), 4) AS recall_{k}" for k in evaluation.CUTS)
       + ", round(sum(coalesce(1.0 / best_rank, 0)) / count(*), 4) AS mrr, list_sort(list(best_rank) FILTER (best_rank IS NOT NULL))[CAST(floor(count(best_rank) / 2) AS INTEGER) + 1] AS median_rank FROM best GROUP BY 1")
def ranking_metrics(t):
    return evaluation.metrics(_best(t))


_RELEVANT = "relevant AS (SELECT DISTINCT user_id AS case_id, (user_id + d) % 97 AS disease_id FROM events CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 7 UNION ALL SELECT 31) x)"


@query(f"""WITH {_RANKS}, {_RELEVANT}, m AS (SELECT case_id, CAST(least(count(*), 10) AS INTEGER) AS m FROM relevant GROUP BY 1),
    d AS (SELECT r.case_id, r.method, sum(1 / log2(rank + 1.0)) AS dcg FROM ranks r JOIN relevant t ON t.case_id = r.case_id AND t.disease_id = r.disease_id GROUP BY 1, 2)
    SELECT c.case_id, c.method, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, m + 1), lambda i: 1 / log2(i + 1.0))), 5) AS ndcg
    FROM (SELECT DISTINCT case_id, method FROM ranks) c JOIN m ON m.case_id = c.case_id LEFT JOIN d ON d.case_id = c.case_id AND d.method = c.method""")
def ndcg_multi_hit(t):
    relevant = t.events.select(F.col("user_id").alias("case_id"), F.explode(F.array(F.lit(0), F.lit(7), F.lit(31))).alias("d")).select("case_id", ((F.col("case_id") + F.col("d")) % 97).alias("disease_id")).distinct()
    return evaluation.ndcg(fusion.rank_methods(t.ranked), relevant)


@query(f"""WITH {_BEST}, f AS (SELECT case_id, count(*) FILTER (best_rank <= 10) AS n_found, count(*) AS n FROM best GROUP BY 1)
    SELECT n_found, CASE WHEN n_found = 0 THEN 'hard' WHEN n_found = n THEN 'consensus' WHEN n_found = 1 THEN 'unique' ELSE 'partial' END AS kind, count(*) AS n_cases FROM f GROUP BY 1, 2""")
def agreement_stats(t):
    return evaluation.agreement_stats(_best(t))


@query(f"WITH {_BEST} SELECT method, best_rank, count(*) AS n FROM best GROUP BY 1, 2")
def rank_histogram(t):
    return evaluation.rank_histogram(_best(t))


@query("SELECT method, round(avg(seconds), 3) AS avg_seconds, count(*) AS n FROM timing GROUP BY 1")
def method_timing(t):
    return evaluation.timing(t.timing)


# --- dense vectors ----------------------------------------------------------------------
_DENSE = {
    "cosine": "list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e)))",
    "euclidean": "1 / (1 + list_distance(q.e, d.e))",
}
for _m, _e in _DENSE.items():
    def _dense(t, m=_m):
        items = t.embeddings.select(F.col("vec_id").alias("disease_id"), F.col("embedding").alias("vector"))
        return dense.rank(items.withColumnRenamed("disease_id", "patient_id").where("patient_id % 20 = 0"), items, m)

    query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS patient_id, d.vec_id AS disease_id, round({_e}, 5) AS score FROM v q CROSS JOIN v d WHERE q.vec_id % 20 = 0)
        SELECT patient_id, CAST(r AS INTEGER) AS rank, disease_id, score FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, disease_id) AS r FROM s) WHERE r <= 10""", f"dense_{_m}_topk")(_dense)


@query("""SELECT label, CAST(d - 1 AS INTEGER) AS dim, round(sum((1 + vec_id % 3) * CAST(embedding[d] AS DOUBLE)) / sum(1.0 + vec_id % 3), 5) AS value
    FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2""")
def weighted_mean_embedding(t):
    e = t.embeddings
    weights = e.select(F.col("vec_id").alias("term"), (1.0 + F.col("vec_id") % 3).alias("weight"))
    return dense.weighted_mean(e.select("label", F.col("vec_id").alias("term"), F.col("embedding").cast("array<double>").alias("vector")), weights, "label")


# --- extraction -------------------------------------------------------------------------
@query("SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def normalize_texts(t):
    return t.conversations.select("conv_id", "turn", "role", normalize_text(F.col("text")).alias("text"))


@query("""SELECT doc_id, p AS start, list_bool_or(list_transform(['no', 'not', 'without', 'denies', 'denied', 'negative for', 'absence of'],
      lambda w: contains(substring(text, CAST(greatest(p - 50, 0) + 1 AS BIGINT), CAST(p - greatest(p - 50, 0) AS BIGINT)), w))) AS negated
    FROM (SELECT doc_id, text, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + 4 * (i - 1) AS INTEGER) AS p, i, n FROM (
      SELECT doc_id, text, unnest(string_split(text, 'tion')) AS part, generate_subscripts(string_split(text, 'tion'), 1) AS i, len(string_split(text, 'tion')) AS n FROM documents)) WHERE i < n""")
def negation_window(t):
    found = F.transform(starts_of(F.col("text"), "tion"), lambda s: F.struct(s.alias("start"), is_negated(F.col("text"), s).alias("negated")))
    return t.documents.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.start", "x.negated")


@query("SELECT p_partkey AS term, p_name AS label FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_partkey LIMIT 20")
def label_search(t):
    return t.term_label.where(F.lower("label").contains("an")).orderBy("term").limit(20)


@query("""SELECT event_type, user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS confidence FROM events WHERE user_id NOT IN (SELECT user_id FROM blocked) GROUP BY 1, 2""")
def dedup_extractions(t):
    best = F.max(F.struct("value", (-F.col("event_id")).alias("e")))
    kept = t.events.join(t.blocked, "user_id", "left_anti").groupBy("event_type", "user_id").agg(best.alias("b"))
    return kept.select("event_type", "user_id", (-F.col("b.e")).alias("event_id"), F.col("b.value").alias("confidence"))


@query("""SELECT p_brand, p_partkey, p_name FROM (SELECT *, sum(length(p_name) + 2) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS used
    FROM part p WHERE p_size >= 30 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size >= 30)) WHERE used <= 650""")
def label_budget(t):
    rows = t.part.select("p_brand", F.col("p_partkey").alias("term"), F.col("p_name").alias("label"), (F.col("p_size") / 20.0).alias("ic"))
    return extraction.label_budget(rows, "p_brand").select("p_brand", F.col("term").alias("p_partkey"), F.col("label").alias("p_name"))
