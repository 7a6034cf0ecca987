"""Engine tables from the driver's tables, as SQL that Spark and DuckDB both run.

The driver tables hold no phenotype data; customers stand in for profiles, parts
for terms, orders for patients, and part numbers form a directed acyclic graph.
Searches ask with the patients, texts and vectors whose id is divisible by 20
(``asked_*``) against all rows; everything else takes whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "profile": "SELECT c_custkey AS disease_id FROM customer",
    "profile_term": "SELECT DISTINCT o_custkey AS disease_id, l_partkey AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "patient_term": "SELECT DISTINCT l_orderkey AS patient_id, l_partkey AS term FROM lineitem",
    "asked_term": "SELECT DISTINCT l_orderkey AS patient_id, l_partkey AS term FROM lineitem WHERE l_orderkey % 20 = 0",
    "patient_excluded": "SELECT DISTINCT l_orderkey AS patient_id, l_partkey AS term FROM lineitem WHERE l_returnflag = 'R'",
    "asked_excluded": "SELECT DISTINCT l_orderkey AS patient_id, l_partkey AS term FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 20 = 0",
    "profile_negative": "SELECT DISTINCT o_custkey AS disease_id, l_partkey AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
    "profile_text": "SELECT o_custkey AS disease_id, string_agg(p_name, ' ') AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' GROUP BY o_custkey",
    "truth": "SELECT o_orderkey AS patient_id, o_custkey AS disease_id FROM orders",
    "edge": "SELECT p_partkey AS child, CAST(floor(p_partkey / 4) AS BIGINT) AS parent FROM part WHERE p_partkey > 0"
    " UNION SELECT p_partkey AS child, CAST(floor(p_partkey / 7) AS BIGINT) AS parent FROM part WHERE p_partkey > 0 AND p_partkey % 5 = 0",
    "term_label": "SELECT p_partkey AS term, p_name AS label FROM part",
    "term_text": "SELECT p_partkey AS term, p_name AS text FROM part",
    "alias": "SELECT c_custkey AS alias_id, c_custkey - c_custkey % 3 AS canonical_id FROM customer",
    "annotation": "SELECT o_custkey AS disease_id, l_partkey AS term, l_linenumber % 4 AS source_priority, CASE WHEN l_returnflag = 'R' THEN 'NOT' END AS qualifier,"
    " CAST(floor(l_discount * 50) AS BIGINT) AS frequency_rank, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "metadata": "SELECT 1 AS source_ord, 'ORDO' AS source, c_custkey AS ord, 'Orphanet_' || c_custkey AS local_id, 'ORPHA:' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS label,"
    " CASE WHEN c_custkey % 4 = 0 THEN ' ' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment || ' ' END AS description, 'OMIM:' || (c_custkey + 7) || ';MONDO_' || c_custkey AS xrefs, '' AS matches,"
    " CASE c_custkey % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'specific_disease' END AS profile_type FROM customer WHERE c_custkey % 2 = 0"
    " UNION ALL SELECT 2, 'MONDO', p_partkey, 'MONDO_' || p_partkey, 'MONDO:' || p_partkey, p_name, p_type, 'OMIM:' || (p_partkey * 3) || ';Orphanet:' || p_partkey,"
    " CASE WHEN p_partkey % 3 = 0 THEN 'http://x.org/Orphanet_' || (p_partkey - p_partkey % 2) ELSE '' END, NULL FROM part",
    "note": "SELECT l_orderkey * 10 + l_linenumber AS ord, CASE o_custkey % 4 WHEN 0 THEN 'ORPHA:' || o_custkey WHEN 1 THEN 'OMIM:' || o_custkey WHEN 2 THEN 'MONDO:' || o_custkey END AS raw_id,"
    " CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'name ' || o_custkey END AS name, l_partkey AS term, CASE WHEN l_quantity > 25 THEN 'VF' END AS frequency,"
    " CASE WHEN l_linenumber % 2 = 0 THEN 'HPOA' ELSE 'MONARCH' END AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "labelled": "SELECT p_partkey AS term, p_name AS label, p_partkey AS ord FROM part WHERE p_size <= 40",
    "speech": "SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations",
    "phrase": "SELECT min(conv_id * 1000 + turn) AS term, min(conv_id * 1000 + turn) AS ord, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS label FROM conversations WHERE turn = 0 GROUP BY split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)",
    "metric": "SELECT o_orderpriority AS label, CASE WHEN o_custkey % 3 = 0 THEN 'tool' ELSE 'method' END AS system, o_custkey % 7 AS dataset, count(*) AS n,"
    " avg(CASE WHEN o_totalprice > 200000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS recall_1, avg(CASE WHEN o_totalprice > 100000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS recall_10,"
    " avg(CASE WHEN o_totalprice > 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS mrr, avg(o_totalprice / 1000) AS seconds FROM orders GROUP BY 1, 2, 3",
    "ranked": "SELECT user_id AS case_id, event_type AS method, event_id % 97 AS disease_id, max(value) AS score FROM events GROUP BY 1, 2, 3",
    "case_truth": "SELECT DISTINCT user_id AS case_id, user_id % 97 AS disease_id FROM events",
    "blocked": "SELECT user_id FROM events GROUP BY 1 HAVING max(value) < 60",
    "timing": "SELECT user_id AS case_id, event_type AS method, sum(value) AS seconds FROM events GROUP BY 1, 2",
    "doc": "SELECT doc_id AS disease_id, text FROM documents",
    "query_text": "SELECT item_id AS patient_id, text FROM benchmark",
    "asked_text": "SELECT item_id AS patient_id, text FROM benchmark WHERE item_id % 20 = 0",
}
INPUTS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations")


class Tables:
    """Lazy engine tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            return self.raw(name)
        sql = TABLES[name]
        views = {t: self.raw(t) for t in INPUTS if f" {t}" in sql}
        for t in views:
            sql = sql.replace(f" {t} ", f" {{{t}}} ") if f" {t} " in sql else sql.replace(f" {t}", f" {{{t}}}")
        return self.spark.sql(sql, **views)


def with_tables(query: str) -> str:
    """Oracle SQL with the engine tables that it names, and theirs, in front."""
    used = [n for n in TABLES if f" {n}" in query.replace("\n", " ") or f"({n}" in query]
    if not used:
        return query.strip()
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" for n in used)
    head, _, rest = query.strip().partition("WITH ")
    if not head and rest.startswith("RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest.removeprefix('RECURSIVE ')}"
    return f"WITH {ctes},\n{rest}" if not head else f"WITH {ctes}\n{query.strip()}"
