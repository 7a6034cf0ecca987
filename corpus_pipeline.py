"""Corpus pipeline: language ID, exact and near duplicates, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenoweave.llm import bpe, dedup, jaccard, langid, mixing
from phenoweave.llm.queries import VOCABULARY
from phenoweave.llm.store import materialize, placed, remove, unused

#: Documents whose predicted language is less likely than this are rejected.
LEAST_LANGUAGE_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learnt language: not ``und``, and no doubtful prediction.

    A null text is ``und`` and goes; a null lang or doc_id is no reason to go.
    Repeated rows all stay or all go, columns of any name are carried, an empty
    table stays empty.
    """
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))
    model = langid.fit(docs, learn)
    names = unused(docs, "lang_pred"), unused(docs, "score")
    scored = langid.predict(docs, model, docs.columns, names)
    return scored.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays; the texts of all null rows are equal and empty.

    Of repeated rows one stays, columns of any name are carried, an empty table
    stays empty.
    """
    return dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard 0.8 or more on five words, the least doc_id stays.

    Null doc_ids come last; rows that share a doc_id are told apart by their text
    or place.  Documents without words link with nothing and stay.  Columns of any
    name are carried, an empty table stays empty.
    """
    place = unused(docs, "place")
    rows = placed(docs, place)
    linked = jaccard.jaccard_join(rows.select(F.col(place).alias("doc_id"), "text"), width=5, num=80, den=100)
    members = linked.where("n_shingles > 0").select(F.col("doc_id").alias("at"), F.col("component_id").alias("component"))
    ids = materialize(members.join(rows.select(F.col(place).alias("at"), F.col("doc_id").alias("id")), "at"), "near-members")
    order = F.struct(F.col("id").isNull().alias("u"), "id", "at")
    keeps = ids.groupBy("component").agg(F.min(order).alias("k"), F.count("*").alias("n")).where("n > 1").select("component", F.col("k.at").alias("kept"))
    gone = ids.join(keeps, "component").where("at <> kept").select(F.col("at").alias(place))
    return rows.join(gone, place, "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words weigh nothing and stay.  A null source is a source,
    repeated rows are taken apart, columns of any name are carried, an empty
    table stays empty.
    """
    place, times, copy = unused(docs, "place"), unused(docs, "times"), unused(docs, "copy")
    rows = placed(docs, place)
    named = rows.select("doc_id", "source", "text", F.col(place).alias("at"))
    taken = mixing.mix(named, carried=["at"]).select(F.col("at").alias(place), F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1).cast("int").alias(times))
    out = rows.join(taken.where(F.col(times) > 0), place)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, for every row; a null text is empty."""
    return bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("language", language_stage),
    ("exact_duplicates", exact_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Language models, the mix's hashes and BPE are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"pipeline-{name}")
            if name != STAGES[0][0]:
                remove(before, spark)  # a written stage that nobody reads again
    return docs
