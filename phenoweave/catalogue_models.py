"""Registered queries of canonical profiles, extraction, model answers, explanations, evaluation by aliases and trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _IC, _RANKED_PAIRS, _RANKS, LEAST_IC, ORACLES, QUERIES, _ic, _ranked_pairs, query
from .catalogue_reports import _PROFILE_IDF, _asked_labels
from .functions import identifiers
from .operators import answers, autoencoder, canonical, comparison, dense, explain, extraction, fusion, graph, ontology

__all__ = ["ORACLES", "QUERIES"]

# --- identifiers ------------------------------------------------------------------------
_REFS = """CASE c_custkey % 7 WHEN 0 THEN 'Orphanet:' || c_custkey || '; ORPHA:1' WHEN 1 THEN ' ORPHANET:' || c_custkey WHEN 2 THEN 'orpha_' || c_custkey || ';MIM:' || c_custkey
    WHEN 3 THEN 'ORPHA : ' || c_custkey || ';OMIM: ' || c_custkey || ';omim:5' WHEN 4 THEN 'ORPHA:' || c_custkey || 'x;MONDO:000' || c_custkey WHEN 5 THEN 'xORPHA:1;OMIM_' || c_custkey ELSE 'MONDO_' || c_custkey || ';DOID:4' END"""


def _refs(t):
    return t.customer.select("c_custkey", F.split(F.expr(_REFS.replace("c_custkey ||", "CAST(c_custkey AS STRING) ||")), ";").alias("refs"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 < 4 THEN 'ORPHA:' || c_custkey END AS id FROM customer")
def extract_orpha(t):
    return _refs(t).select("c_custkey", identifiers.first_orpha(F.col("refs")).alias("id"))


@query("""SELECT c_custkey, CASE c_custkey % 7 WHEN 2 THEN 'OMIM:' || c_custkey WHEN 3 THEN 'OMIM:' || c_custkey || ',OMIM:5' WHEN 5 THEN 'OMIM:' || c_custkey ELSE '' END AS ids FROM customer""")
def extract_omim(t):
    return _refs(t).select("c_custkey", F.array_join(identifiers.identifiers_in(F.col("refs"), "OMIM"), ",").alias("ids"))


@query("SELECT c_custkey, CASE c_custkey % 7 WHEN 4 THEN 'MONDO:000' || c_custkey WHEN 6 THEN 'MONDO:' || c_custkey ELSE '' END AS ids FROM customer")
def extract_mondo(t):
    return _refs(t).select("c_custkey", F.array_join(identifiers.identifiers_in(F.col("refs"), "MONDO"), ",").alias("ids"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'category' WHEN 1 THEN 'disease_group' WHEN 2 THEN 'clinical_subtype' WHEN 3 THEN 'etiological_subtype' WHEN 4 THEN 'subtype' WHEN 5 THEN 'specific_disease' END AS profile_type,
    CASE p_partkey % 8 WHEN 0 THEN 'Category' WHEN 1 THEN 'Disease group' WHEN 2 THEN 'Clinical subtype' WHEN 3 THEN 'Etiological subtype' WHEN 4 THEN 'Subtype' WHEN 5 THEN 'Specific disease' END AS shown FROM part""")
def profile_types(t):
    raw = F.expr("CASE p_partkey % 8 WHEN 0 THEN ' Category ' WHEN 1 THEN 'Group of disorders' WHEN 2 THEN 'Clinical subtype' WHEN 3 THEN 'Aetiological subtype' WHEN 4 THEN 'other subtype' WHEN 5 THEN 'Disease' WHEN 6 THEN 'ORPHA:12' ELSE 'free text' END")
    kind = identifiers.normalize_profile_type(raw)
    return t.part.select("p_partkey", kind.alias("profile_type"), identifiers.profile_type_label(kind).alias("shown"))


# --- canonical profiles -----------------------------------------------------------------
_MAP = """given AS (SELECT 1 AS so, c_custkey AS ord, 'ORPHA:' || c_custkey AS target, 'OMIM:' || (c_custkey + 7) AS name FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 1, c_custkey, 'ORPHA:' || c_custkey, 'MONDO:' || c_custkey FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 2, p_partkey, 'ORPHA:' || (p_partkey - p_partkey % 2), 'MONDO:' || p_partkey FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT 2, p_partkey, 'ORPHA:' || (p_partkey - p_partkey % 2), 'OMIM:' || (p_partkey * 3) FROM part WHERE p_partkey % 3 = 0),
    mapping AS (SELECT name AS id, arg_max(target, (so, ord)) AS target FROM given GROUP BY 1)"""
_RESOLVED = f"""{_MAP}, raws AS (SELECT DISTINCT raw_id FROM note WHERE raw_id IS NOT NULL AND term IN (SELECT term FROM labelled) UNION SELECT id FROM metadata),
    resolved AS (SELECT raw_id, CASE WHEN raw_id LIKE 'ORPHA:%' THEN raw_id ELSE coalesce(target, 'ORPHA:' || p_partkey, raw_id) END AS canonical_id
      FROM raws LEFT JOIN mapping ON mapping.id = raw_id LEFT JOIN part ON 'MONDO:' || p_partkey = raw_id)"""
_FOLD = f"""{_RESOLVED}, records AS (SELECT canonical_id, n.raw_id, 0 AS so, ord, NULL AS source, trim(name) AS label, NULL AS description, NULL AS profile_type FROM note n JOIN resolved r ON r.raw_id = n.raw_id WHERE term IN (SELECT term FROM labelled)
      UNION ALL SELECT canonical_id, id, source_ord, ord, source, nullif(trim(label), ''), nullif(trim(description), ''), profile_type FROM metadata JOIN resolved r ON r.raw_id = id),
    folded AS (SELECT canonical_id, coalesce(first(label ORDER BY so, ord), canonical_id) AS label, last(description ORDER BY ord) FILTER (source = 'ORDO') AS ordo_description, last(description ORDER BY ord) FILTER (source = 'MONDO') AS mondo_description,
      last(profile_type ORDER BY ord) FILTER (source = 'ORDO' AND profile_type IS NOT NULL) AS profile_type, bool_or(canonical_id <> raw_id) AS canonicalized, count(*) AS n_records FROM records GROUP BY 1)"""


def _metadata(t):
    some = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    return t.metadata.withColumns({"xrefs": some("xrefs"), "exact_matches": some("matches")}).drop("matches")


def _folded(t):
    meta = _metadata(t)
    return canonical.fold(t.note, meta, canonical.mapping_from_metadata(meta), t.labelled)


@query(f"WITH {_MAP} SELECT id, target FROM mapping")
def metadata_mapping(t):
    return canonical.mapping_from_metadata(_metadata(t))


@query(f"WITH {_RESOLVED} SELECT raw_id AS alias_id, canonical_id FROM resolved")
def resolve_canonical(t):
    meta = _metadata(t)
    return canonical.aliases(t.note, meta, canonical.mapping_from_metadata(meta), t.labelled)


@query(f"WITH {_FOLD} SELECT canonical_id, label, ordo_description, mondo_description, profile_type, canonicalized, n_records FROM folded")
def profile_fold(t):
    return _folded(t).select("canonical_id", "label", "ordo_description", "mondo_description", "profile_type", "canonicalized", "n_records")


@query(f"WITH {_FOLD} SELECT canonical_id, coalesce(ordo_description, mondo_description) AS merged_description FROM folded")
def merged_description(t):
    return _folded(t).select("canonical_id", "merged_description")


@query(f"""WITH {_FOLD}, keys AS (SELECT canonical_id, lower(n.source) || '_original_id' AS k, n.raw_id AS v, 0 AS so, n.ord FROM note n JOIN resolved r ON r.raw_id = n.raw_id WHERE term IN (SELECT term FROM labelled)
      UNION ALL SELECT canonical_id, lower(n.source) || '_frequency_codes', frequency, 0, n.ord FROM note n JOIN resolved r ON r.raw_id = n.raw_id WHERE term IN (SELECT term FROM labelled) AND frequency IS NOT NULL
      UNION ALL SELECT canonical_id, lower(source) || '_id', id, source_ord, ord FROM metadata JOIN resolved r ON r.raw_id = id
      UNION ALL SELECT canonical_id, lower(source) || '_local_id', local_id, source_ord, ord FROM metadata JOIN resolved r ON r.raw_id = id)
    SELECT canonical_id, k AS key, arg_max(v, (so, ord)) AS value FROM keys GROUP BY 1, 2""")
def source_ids(t):
    return _folded(t).select("canonical_id", F.explode("source_ids").alias("key", "value"))


@query("SELECT c_custkey AS id, c_custkey - c_custkey % 3 + d AS other FROM customer CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE c_custkey - c_custkey % 3 + d IN (SELECT c_custkey FROM customer)")
def equivalent_ids(t):
    return canonical.equivalents(t.alias)


@query("SELECT disease_id, term, 'positive' AS kind FROM profile_term UNION ALL SELECT disease_id, term, 'negative' FROM profile_negative")
def exclusion_inputs(t):
    return t.profile_term.withColumn("kind", F.lit("positive")).unionByName(t.profile_negative.withColumn("kind", F.lit("negative")))


# --- extraction -------------------------------------------------------------------------
_CLEAN = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
_FOUND = f"""lookup AS (SELECT {_CLEAN.format('label')} AS name, arg_max(term, ord) AS term, min(ord) AS ord FROM phrase WHERE {_CLEAN.format('label')} <> '' GROUP BY 1),
    clean AS (SELECT turn_id, {_CLEAN.format('text')} AS text FROM speech),
    found AS (SELECT turn_id, term, name, text, CAST(p - 1 AS INTEGER) AS start FROM (
      SELECT turn_id, term, name, text, unnest(list_filter(range(1, length(text) + 1), lambda i: text[i : i + length(name) - 1] = name)) AS p FROM clean JOIN lookup ON contains(text, name))
      WHERE NOT regexp_matches(substring(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '[a-z0-9]') AND NOT regexp_matches(substring(text, p + length(name), 1), '[a-z0-9]') AND regexp_matches(name, '^[a-z0-9](.*[a-z0-9])?$')),
    marked AS (SELECT *, list_bool_or(list_transform(['no', 'not', 'without', 'denies', 'denied', 'negative for', 'absence of'],
      lambda w: contains(substring(text, CAST(greatest(start - 50, 0) + 1 AS BIGINT), CAST(start - greatest(start - 50, 0) AS BIGINT)), w))) AS negated FROM found)"""


@query(f"WITH {_FOUND} SELECT turn_id, term, name AS matched_text, start, CAST(start + length(name) AS INTEGER) AS \"end\" FROM marked WHERE NOT negated")
def dictionary_extract(t):
    return extraction.dictionary(t.speech, "turn_id", extraction.label_lookup(t.phrase)).select("turn_id", "term", "matched_text", "start", "end")


@query(f"WITH {_FOUND}, k AS (SELECT turn_id, term, arg_min(start, start) AS start FROM marked WHERE NOT negated GROUP BY 1, 2) SELECT turn_id, term, start, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY start, term) AS INTEGER) AS place FROM k")
def extraction_ensemble(t):
    return extraction.ensemble(t.speech, "turn_id", t.phrase).select("turn_id", "term", "start", "place")


@query(f"""WITH {_FOUND}, n AS (SELECT turn_id, count(DISTINCT term) AS n FROM marked WHERE NOT negated GROUP BY 1), a AS (SELECT turn_id, coalesce(n, 0) AS n FROM speech LEFT JOIN n USING (turn_id))
    SELECT count(*) AS n_cases, round(avg(n), 4) AS mean_terms, min(n) AS least_terms, max(n) AS most_terms, count(*) FILTER (n = 0) AS n_empty FROM a""")
def extraction_summary(t):
    return extraction.summary(t.speech, extraction.ensemble(t.speech, "turn_id", t.phrase), "turn_id")


_PHRASES = "asked AS (SELECT turn_id, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) AS phrase FROM speech)"


@query(f"""WITH lookup AS (SELECT {_CLEAN.format('label')} AS name, arg_max(term, ord) AS term, min(ord) AS ord FROM phrase WHERE {_CLEAN.format('label')} <> '' GROUP BY 1),
    {_PHRASES}, n AS (SELECT turn_id, phrase, {_CLEAN.format('phrase')} AS p FROM asked WHERE {_CLEAN.format('phrase')} <> ''),
    near AS (SELECT p, arg_min(term, ord) AS term FROM (SELECT DISTINCT p FROM n WHERE length(p) >= 8) x JOIN lookup ON length(name) >= 8 AND (contains(name, p) OR contains(p, name)) GROUP BY 1)
    SELECT turn_id, phrase, coalesce(lookup.term, near.term) AS term FROM n LEFT JOIN lookup ON name = n.p LEFT JOIN near ON near.p = n.p WHERE coalesce(lookup.term, near.term) IS NOT NULL""")
def phrase_match(t):
    asked = t.speech.select("turn_id", F.concat_ws(" ", *[F.split_part("text", F.lit(" "), F.lit(i)) for i in (2, 3, 4)]).alias("phrase"))
    return extraction.match_phrases(asked, extraction.label_lookup(t.phrase), "gpt").select("turn_id", "phrase", "term")


# --- model answers ----------------------------------------------------------------------
_ANSWER = """'[INST] DISEASE: no | ORDO: ORPHA:0 | MATCH: no | CONFIDENCE: no [/INST]\\nDISEASE: Name ' || c_custkey || ' | ORDO: ORPHA' || c_custkey || ' | MATCH: tall, thin |\\n CONFIDENCE: '
    || CASE c_custkey % 3 WHEN 0 THEN 'Weak' WHEN 1 THEN 'high' ELSE 'strong' END || '\\nDISEASE: ' || c_name || ' | ORDO: OMIM:7 | MATCH: short | CONFIDENCE: possible\\ndisease: again | ordo: ORPHA:' || c_custkey || ' | match: x | note: strong'"""
_PARSED = """SELECT c_custkey AS case_id, 0 AS ord, 'Name ' || c_custkey AS name, 'ORPHA:' || c_custkey AS id, 'tall, thin' AS matched, CASE c_custkey % 3 WHEN 0 THEN 'weak' WHEN 1 THEN 'high' ELSE 'strong' END AS confidence FROM customer
    UNION ALL SELECT c_custkey, 1, c_name, 'OMIM:7', 'short', 'possible' FROM customer UNION ALL SELECT c_custkey, 2, 'again', 'ORPHA:' || c_custkey, 'x', 'strong' FROM customer"""


def _answers(t):
    return t.customer.select(F.col("c_custkey").alias("case_id"), F.expr(_ANSWER.replace("|| c_custkey", "|| CAST(c_custkey AS STRING)")).alias("text"))


def _named_profiles(t):
    return t.customer.select(F.concat(F.lit("ORPHA:"), F.col("c_custkey").cast("string")).alias("disease_id"), F.col("c_name").alias("label"), F.col("c_custkey").alias("ord")).where("ord % 2 = 0")


@query(_PARSED)
def parse_llm_records(t):
    return answers.records(_answers(t), "case_id")


@query(f"""WITH p AS ({_PARSED}), prof AS (SELECT 'ORPHA:' || c_custkey AS disease_id, c_name AS label, c_custkey AS ord FROM customer WHERE c_custkey % 2 = 0),
    m AS (SELECT p.*, coalesce(e.disease_id, (SELECT arg_min(q.disease_id, q.ord) FROM prof q WHERE contains(lower(q.label), lower(p.name)) OR contains(lower(p.name), lower(q.label))), p.id) AS matched_id FROM p LEFT JOIN prof e ON e.disease_id = p.id),
    o AS (SELECT *, row_number() OVER (PARTITION BY case_id, matched_id ORDER BY ord) AS r FROM m)
    SELECT case_id, matched_id, CAST(CASE confidence WHEN 'strong' THEN 0.9 WHEN 'possible' THEN 0.6 WHEN 'weak' THEN 0.3 ELSE 0.5 END AS DOUBLE) AS score,
      CAST(row_number() OVER (PARTITION BY case_id ORDER BY CASE confidence WHEN 'strong' THEN 0.9 WHEN 'possible' THEN 0.6 WHEN 'weak' THEN 0.3 ELSE 0.5 END DESC, ord) AS INTEGER) AS rank FROM o WHERE r = 1""")
def rank_llm_answers(t):
    return answers.ranked_answers(_answers(t), "case_id", _named_profiles(t)).select("case_id", "matched_id", "score", "rank")


# --- explanations -----------------------------------------------------------------------
@query(f"""WITH {_RANKED_PAIRS}, {_IC}, shared AS (SELECT b.patient_id, b.disease_id, p.term, coalesce(ic.ic, 0) AS ic, p.term IN (SELECT term FROM asked_excluded e WHERE e.patient_id = b.patient_id) AS d
      FROM best b JOIN asked_term p ON p.patient_id = b.patient_id JOIN profile_term t ON t.disease_id = b.disease_id AND t.term = p.term LEFT JOIN ic ON ic.term = p.term)
    SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, term, round(ic, 6) AS ic, CASE WHEN d THEN 'direct' ELSE 'propagated' END AS match_type FROM (
      SELECT *, row_number() OVER (PARTITION BY patient_id, disease_id ORDER BY round(ic, 9) DESC, term) AS rank FROM shared) WHERE rank <= 15""")
def explained_matches(t):
    return explain.matched_terms(_ranked_pairs(t), t.asked_term, t.asked_excluded, t.profile_term, _ic(t)).drop("match_score")


@query(f"""WITH {_RANKED_PAIRS}, {_IC} SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, term, round(ic, 6) AS ic FROM (
      SELECT b.patient_id, b.disease_id, e.term, coalesce(ic.ic, 0) AS ic, row_number() OVER (PARTITION BY b.patient_id, b.disease_id ORDER BY round(coalesce(ic.ic, 0), 9) DESC, e.term) AS rank
      FROM best b JOIN asked_excluded e ON e.patient_id = b.patient_id JOIN profile_term t ON t.disease_id = b.disease_id AND t.term = e.term LEFT JOIN ic ON ic.term = e.term) WHERE rank <= 10""")
def excluded_terms_topn(t):
    return explain.excluded_terms(_ranked_pairs(t), t.asked_excluded, t.profile_term, _ic(t))


@query(f"""WITH {_RANKED_PAIRS}, clash AS (SELECT b.patient_id, b.disease_id, e.term FROM best b JOIN asked_excluded e ON e.patient_id = b.patient_id JOIN profile_term t ON t.disease_id = b.disease_id AND t.term = e.term
      UNION SELECT b.patient_id, b.disease_id, p.term FROM best b JOIN asked_term p ON p.patient_id = b.patient_id JOIN profile_negative t ON t.disease_id = b.disease_id AND t.term = p.term),
    n AS (SELECT patient_id, disease_id, count(*) AS n FROM clash GROUP BY 1, 2)
    SELECT b.patient_id, b.disease_id, c AS n_common, a AS n_patient, x.b AS n_disease, a + x.b - c AS n_union, least(a, x.b) AS n_least, coalesce(n, 0) AS n_clash, round(0.5 * coalesce(n, 0) / (a + x.b - c), 4) AS applied_penalty
    FROM best b JOIN pairs x ON x.patient_id = b.patient_id AND x.disease_id = b.disease_id LEFT JOIN n ON n.patient_id = b.patient_id AND n.disease_id = b.disease_id""")
def penalty_components(t):
    return explain.penalty(_ranked_pairs(t), t.asked_term, t.profile_term, t.asked_excluded, t.profile_negative).drop("weight")


@query(f"""WITH {_IC}, low AS (SELECT patient_id, p.term, coalesce(ic, 0) AS ic FROM patient_term p LEFT JOIN ic ON ic.term = p.term WHERE coalesce(ic, 0) < {LEAST_IC})
    SELECT patient_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY round(ic, 9), term) AS INTEGER) AS rank, term, round(ic, 6) AS ic FROM low""")
def removed_by_ic(t):
    return explain.removed_terms(t.patient_term, _ic(t), LEAST_IC)


def _explained(t):
    pairs = _ranked_pairs(t)
    return explain.terms(pairs, t.asked_term, t.asked_excluded, t.profile_term, _ic(t), t.asked_excluded, t.profile_negative)


@query(f"""WITH {_RANKED_PAIRS}, {_IC}, s AS (SELECT b.patient_id, b.disease_id, round(sum(coalesce(ic.ic, 0)), 5) AS ic_sum FROM best b JOIN asked_term p ON p.patient_id = b.patient_id JOIN profile_term t ON t.disease_id = b.disease_id AND t.term = p.term LEFT JOIN ic ON ic.term = p.term GROUP BY 1, 2)
    SELECT b.patient_id, b.disease_id, a + x.b - c AS n_union, round(c / CAST(a AS DOUBLE), 4) AS patient_coverage, least(c, 15) AS n_matched, least(a - c, 10) AS n_unmatched, ic_sum, least(c, 5) AS n_top
    FROM best b JOIN pairs x ON x.patient_id = b.patient_id AND x.disease_id = b.disease_id LEFT JOIN s ON s.patient_id = b.patient_id AND s.disease_id = b.disease_id""")
def explanation_blocks(t):
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    return _explained(t).select("patient_id", "disease_id", "components.n_union", F.col("coverage.patient").alias("patient_coverage"), size("matched").alias("n_matched"), size("unmatched").alias("n_unmatched"), "quality.ic_sum", size("quality.top_terms").alias("n_top"))


def _text_pairs(t):
    weights, texts, asked = _asked_labels(t)
    pairs = t.truth.join(t.asked_term.select("patient_id").distinct(), "patient_id", "left_semi")
    return weights, texts, asked, pairs


def token_blocks(t):
    weights, texts, asked, pairs = _text_pairs(t)
    e = explain.texts(pairs, asked, texts, weights)
    return e.select("patient_id", "disease_id", "coverage.n_shared", "coverage.n_query", "coverage.n_text", "coverage.sparse", F.round("vectors.cosine", 5).alias("cosine"), F.round("vectors.dot", 4).alias("dot"))


query(f"""WITH {_PROFILE_IDF}, dw AS (SELECT disease_id, token, tf * idf AS w FROM dt JOIN idf USING (token)),
    p AS (SELECT DISTINCT truth.patient_id, truth.disease_id FROM truth JOIN asked_term a ON a.patient_id = truth.patient_id),
    nq AS (SELECT patient_id, count(*) AS n_query, sqrt(sum(w * w)) AS q FROM qw GROUP BY 1), nt AS (SELECT disease_id, count(*) AS n_text, sqrt(sum(w * w)) AS d FROM dw GROUP BY 1),
    s AS (SELECT p.patient_id, p.disease_id, count(*) AS n, sum(qw.w * dw.w) AS dot FROM p JOIN qw ON qw.patient_id = p.patient_id JOIN dw ON dw.disease_id = p.disease_id AND dw.token = qw.token GROUP BY 1, 2)
    SELECT p.patient_id, p.disease_id, coalesce(n, 0) AS n_shared, n_query, n_text, n_text < 10 AS sparse, round(CASE WHEN q * d > 0 THEN coalesce(dot, 0) / (q * d) ELSE 0 END, 5) AS cosine, round(coalesce(dot, 0), 4) AS dot
    FROM p JOIN nq ON nq.patient_id = p.patient_id JOIN nt ON nt.disease_id = p.disease_id LEFT JOIN s ON s.patient_id = p.patient_id AND s.disease_id = p.disease_id""", "token_blocks")(token_blocks)

query(f"""WITH {_PROFILE_IDF}, p AS (SELECT DISTINCT truth.patient_id, truth.disease_id FROM truth JOIN asked_term a ON a.patient_id = truth.patient_id)
    SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, token, round(idf, 4) AS idf FROM (SELECT p.patient_id, p.disease_id, qw.token, idf.idf, row_number() OVER (PARTITION BY p.patient_id, p.disease_id ORDER BY round(idf.idf, 9) DESC, qw.token) AS rank
      FROM p JOIN qw ON qw.patient_id = p.patient_id JOIN idf ON idf.token = qw.token WHERE EXISTS (SELECT 1 FROM dt WHERE dt.disease_id = p.disease_id AND dt.token = qw.token)) WHERE rank <= 10""", "matched_tokens")(
    lambda t: (lambda w, x, a, p: explain.tokens(p, a, x, w, "matched"))(*_text_pairs(t))
)
query(f"""WITH {_PROFILE_IDF}, p AS (SELECT DISTINCT truth.patient_id, truth.disease_id FROM truth JOIN asked_term a ON a.patient_id = truth.patient_id)
    SELECT patient_id, disease_id, CAST(rank AS INTEGER) AS rank, token, round(idf, 4) AS idf FROM (SELECT p.patient_id, p.disease_id, qw.token, idf.idf, row_number() OVER (PARTITION BY p.patient_id, p.disease_id ORDER BY round(idf.idf, 9) DESC, qw.token) AS rank
      FROM p JOIN qw ON qw.patient_id = p.patient_id JOIN idf ON idf.token = qw.token WHERE NOT EXISTS (SELECT 1 FROM dt WHERE dt.disease_id = p.disease_id AND dt.token = qw.token)) WHERE rank <= 10""", "unmatched_tokens")(
    lambda t: (lambda w, x, a, p: explain.tokens(p, a, x, w, "unmatched"))(*_text_pairs(t))
)


# --- evaluation by aliases --------------------------------------------------------------
def _variant(name: str, rows: str, weight: str) -> str:
    return f"""{name} AS (SELECT case_id, '{name}' AS method, disease_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, disease_id) AS r
      FROM (SELECT case_id, disease_id, sum({weight} / (60 + rank)) AS score FROM {rows} WHERE {weight} <> 0 GROUP BY 1, 2)) WHERE r <= 10)"""


_EVALUATED = f"""{_RANKS}, base AS (SELECT case_id, method, disease_id, rank FROM ranks), tr AS (SELECT case_id, count(DISTINCT disease_id - disease_id % 3) AS n FROM case_truth GROUP BY 1),
    hits1 AS (SELECT DISTINCT b.case_id, b.method FROM base b JOIN case_truth t ON t.case_id = b.case_id AND t.disease_id - t.disease_id % 3 = b.disease_id - b.disease_id % 3),
    recall AS (SELECT m.method, count(h.case_id) / CAST((SELECT count(DISTINCT case_id) FROM base) AS DOUBLE) AS weight FROM (SELECT DISTINCT method FROM base) m LEFT JOIN hits1 h ON h.method = m.method GROUP BY 1),
    heavy AS (SELECT b.*, weight FROM base b JOIN recall USING (method)), chosen AS (SELECT * FROM heavy WHERE weight >= 0.1 OR NOT EXISTS (SELECT 1 FROM recall WHERE weight >= 0.1)),
    {_variant('ensemble_rrf', 'base', '1.0')}, {_variant('ensemble_rrf_weighted', 'heavy', 'weight')}, {_variant('ensemble_rrf_top', 'chosen', '1.0')},
    every AS (SELECT * FROM base UNION ALL SELECT * FROM ensemble_rrf UNION ALL SELECT * FROM ensemble_rrf_weighted UNION ALL SELECT * FROM ensemble_rrf_top),
    hit AS (SELECT DISTINCT e.* FROM every e JOIN case_truth t ON t.case_id = e.case_id AND t.disease_id - t.disease_id % 3 = e.disease_id - e.disease_id % 3),
    per AS (SELECT e.case_id, e.method, min(hit.rank) AS best_rank, coalesce(sum(1 / log2(hit.rank + 1.0)), 0) / max(list_sum(list_transform(range(1, CAST(least(n, 10) AS INTEGER) + 1), lambda i: 1 / log2(i + 1.0)))) AS ndcg
      FROM (SELECT DISTINCT case_id, method FROM every) e JOIN tr ON tr.case_id = e.case_id LEFT JOIN hit ON hit.case_id = e.case_id AND hit.method = e.method GROUP BY 1, 2)"""


@query(f"""WITH {_EVALUATED} SELECT method, count(*) AS n_cases, count(best_rank) AS n_found, round(avg(CASE WHEN best_rank <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN best_rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10,
    round(sum(coalesce(1.0 / best_rank, 0)) / count(*), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM per GROUP BY 1""")
def full_evaluation(t):
    out = comparison.evaluate(fusion.rank_methods(t.ranked), t.case_truth, canonical.equivalents(t.alias), t.timing)
    return out.select("method", "n_cases", "n_found", "recall_1", "recall_10", "mrr", "ndcg")


@query("SELECT case_id, count(DISTINCT disease_id - disease_id % 3) AS n_relevant FROM (SELECT user_id AS case_id, (user_id + d) % 97 AS disease_id FROM events CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 31) x) GROUP BY 1")
def distinct_truth(t):
    truth = t.events.select(F.col("user_id").alias("case_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(31))).alias("d")).select("case_id", ((F.col("case_id") + F.col("d")) % 97).alias("disease_id")).distinct()
    return comparison.distinct_truth(truth, canonical.equivalents(t.alias))


@query(f"""WITH {_RANKS}, f AS (SELECT case_id, disease_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(DISTINCT method) AS n_methods, min(rank) AS best_rank, max(rank) AS worst_rank FROM ranks GROUP BY 1, 2)
    SELECT case_id, CAST(r AS INTEGER) AS rank, disease_id, score, CAST(n_methods AS INTEGER) AS n_methods, best_rank, worst_rank - best_rank AS spread FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, best_rank, disease_id) AS r FROM f) WHERE r <= 10""")
def fused_comparison(t):
    return comparison.fuse(fusion.rank_methods(t.ranked)).select("case_id", "rank", "disease_id", "score", "n_methods", "best_rank", "spread")


@query("SELECT label, round(avg(recall_10), 4) AS recall_10, round(avg(seconds), 3) AS seconds FROM metric GROUP BY 1")
def speed_quality(t):
    return comparison.speed(t.metric)


@query("SELECT 'embedding' AS family, round(avg(recall_10), 4) AS recall_10, count(*) AS n FROM metric")
def family_overview(t):
    return comparison.family_means(t.metric)


@query("SELECT dataset, round(max(recall_10) FILTER (system = 'method'), 4) AS one, round(max(recall_10) FILTER (system = 'tool'), 4) AS two, round(max(recall_10) FILTER (system = 'method') - max(recall_10) FILTER (system = 'tool'), 4) AS lead FROM metric GROUP BY 1")
def system_lead(t):
    return comparison.by_system(t.metric, "method", "tool").withColumns({c: F.round(c, 4) for c in ("one", "two")})


@query("""SELECT label, """ + ", ".join(f"round(max(recall_10) FILTER (dataset = {d}), 4) AS d{d}" for d in range(7)) + """, round(avg(r), 4) AS mean FROM (SELECT label, dataset, recall_10, max(recall_10) OVER (PARTITION BY label, dataset) AS m,
    CASE WHEN row_number() OVER (PARTITION BY label, dataset ORDER BY recall_10 DESC) = 1 THEN recall_10 END AS r FROM metric) GROUP BY 1""")
def best_pivot(t):
    return comparison.best_pivot(t.metric, list(range(7))).withColumns({f"d{d}": F.round(f"d{d}", 4) for d in range(7)})


@query("""SELECT dataset, label, k, round(CASE k WHEN 1 THEN recall_1 ELSE recall_10 END, 4) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY recall_10 DESC, label) AS r FROM (
    SELECT label, dataset, max(recall_10) AS recall_10, arg_max(recall_1, recall_10) AS recall_1 FROM metric WHERE system = 'method' GROUP BY 1, 2)) CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 10) WHERE r <= 3""")
def recall_curves(t):
    return comparison.recall_curves(t.metric.where("system = 'method'"), 3).withColumn("recall", F.round("recall", 4))


@query("SELECT dataset, label, system, round(recall_10, 4) AS recall_10, recall_10 = max(recall_10) OVER (PARTITION BY dataset) AS best_recall_10 FROM metric")
def metric_table(t):
    return comparison.metric_table(t.metric).select("dataset", "label", "system", F.round("recall_10", 4).alias("recall_10"), "best_recall_10")


@query(f"""WITH {_RANKS}, a AS (SELECT DISTINCT r.case_id FROM ranks r JOIN case_truth t ON t.case_id = r.case_id AND t.disease_id = r.disease_id WHERE method = 'view'),
    b AS (SELECT DISTINCT r.case_id FROM ranks r JOIN case_truth t ON t.case_id = r.case_id AND t.disease_id = r.disease_id WHERE method = 'click')
    SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN b.case_id IS NULL THEN 'first' ELSE 'second' END AS only FROM a FULL JOIN b ON a.case_id = b.case_id WHERE a.case_id IS NULL OR b.case_id IS NULL""")
def mode_flips(t):
    best = comparison.best_ranks(fusion.rank_methods(t.ranked), t.case_truth, canonical.equivalents(t.alias.where("alias_id = canonical_id")))
    return comparison.flips(best.where("method = 'view'"), best.where("method = 'click'"))


@query("""WITH RECURSIVE closure AS (SELECT child AS term, parent AS ancestor FROM edge UNION SELECT c.term, e.parent FROM closure c JOIN edge e ON e.child = c.ancestor),
    up AS (SELECT disease_id, term FROM profile_term UNION SELECT disease_id, ancestor FROM profile_term p JOIN closure c ON c.term = p.term),
    n AS (SELECT disease_id, count(*) AS r FROM profile_term GROUP BY 1), m AS (SELECT disease_id, count(*) AS p FROM up GROUP BY 1)
    SELECT count(*) AS n_profiles, count(*) FILTER (p > 0) AS n_propagated, count(*) FILTER (p > r) AS n_expanded FROM m LEFT JOIN n USING (disease_id)""")
def propagation_coverage(t):
    return comparison.propagation_coverage(t.profile_term, ontology.propagate_lists(t.profile_term, ontology.ancestor_lists(t.edge), "disease_id"))


@query("SELECT child AS term, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY parent) AS parents FROM edge GROUP BY 1")
def parent_lists(t):
    listed = t.edge.groupBy(F.col("child").alias("term")).agg(F.array_sort(F.collect_set("parent")).alias("p"))
    return listed.select("term", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("parents"))


# --- dense ranking by canonical id ------------------------------------------------------
@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT q.vec_id AS patient_id, d.vec_id AS alias_id, coalesce(canonical_id, d.vec_id) AS disease_id, round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 5) AS score
      FROM v q CROSS JOIN v d LEFT JOIN alias a ON a.alias_id = d.vec_id WHERE q.vec_id % 20 = 0),
    c AS (SELECT patient_id, disease_id, arg_min(alias_id, (-score, alias_id)) AS alias_id, max(score) AS score FROM s GROUP BY 1, 2)
    SELECT patient_id, CAST(r AS INTEGER) AS rank, disease_id, alias_id, score FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, disease_id) AS r FROM c) WHERE r <= 10""")
def dense_canonical_topk(t):
    items = t.embeddings.select(F.col("vec_id").alias("disease_id"), F.col("embedding").alias("vector"))
    return dense.rank_canonical(items.withColumnRenamed("disease_id", "patient_id").where("patient_id % 20 = 0"), items, t.alias)


# --- trained models: no SQL, tests check their properties -------------------------------
def _graph(t):
    return graph.counted(t.edge, t.profile_term), graph.weights(_ic(t))


@query("""WITH e AS (SELECT 't:' || child AS src, 't:' || parent AS dst FROM edge UNION ALL SELECT 'd:' || disease_id, 't:' || term FROM profile_term)
    SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) GROUP BY 1, 2""")
def graph_edges(t):
    return graph.counted(t.edge, t.profile_term)


@query(None)
def random_walks(t):
    return graph.walks(*_graph(t), length=20, per_node=2).select("node", "walk", F.array_join("path", " ").alias("path"))


@query(None)
def hpo2vec_topk(t):
    edges, weight = _graph(t)
    vectors = graph.embed(graph.walks(edges, weight, length=20, per_node=4), dim=32, window=5, epochs=2)
    return graph.rank(t.asked_term, t.profile_term, vectors, weight)


def _autoencoder(t, measure: str):
    model, terms = autoencoder.fit(t.profile_term, epochs=4, hidden=128, latent=32)
    return autoencoder.rank(t.asked_term, t.profile_term, model, terms, measure)


@query(None)
def autoencoder_topk(t):
    return _autoencoder(t, "euclidean")


@query(None)
def autoencoder_batch_topk(t):
    return _autoencoder(t, "cosine")
