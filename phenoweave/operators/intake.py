"""Patients from identifiers, texts and cases, and rankings as they leave the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_term_id, stripped
from ..plans.ranking import DIGITS
from . import extraction, ontology


def from_ids(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``patient_id, term`` of lists such as ``HP:0000256, hp_0001249`` in ``ids``; unknown forms, and terms without a label, go."""
    terms = rows.select("patient_id", F.explode(F.split("ids", ",")).alias("t")).select("patient_id", normalize_term_id(F.col("t")).alias("term")).where("term is not null").distinct()
    return terms if labels is None else terms.join(labels.select("term"), "term", "left_semi").select("patient_id", "term")


def from_texts(texts: DataFrame, labels: DataFrame, methods: tuple[str, ...] = ("dictionary",)) -> DataFrame:
    """``patient_id, term`` found in ``patient_id, text``; reading a patient whose text gives no term raises."""
    found = extraction.ensemble(texts, "patient_id", labels, list(methods)).select("patient_id", "term")
    every = texts.select("patient_id").distinct().join(found, "patient_id", "left")
    stop = F.raise_error(F.concat(F.lit("no term in the text of "), F.col("patient_id").cast("string")))
    return every.withColumn("term", F.when(F.col("term").isNull(), stop.cast(found.schema["term"].dataType)).otherwise(F.col("term")))


def profiles(terms: DataFrame, ancestors: DataFrame) -> DataFrame:
    """``patient_id, hpo_terms, propagated_hpo_terms``, both sorted."""
    up = ontology.propagate(terms, ancestors, "patient_id")
    listed = lambda df, name: df.groupBy("patient_id").agg(F.array_sort(F.collect_set("term")).alias(name))
    return listed(terms, "hpo_terms").join(listed(up, "propagated_hpo_terms"), "patient_id")


def case_id(index: Column) -> Column:
    return F.concat(F.lit("eval_case_"), F.lpad(index.cast("string"), 4, "0"))


def active_terms(patients: DataFrame, propagated: bool) -> DataFrame:
    """``patient_id, term`` of the column that a run is told to use."""
    return patients.select("patient_id", F.explode("propagated_hpo_terms" if propagated else "hpo_terms").alias("term"))


def result_id(rows: DataFrame) -> Column:
    """The first of a row's id columns that isn't blank, as methods name them."""
    names = [c for c in ("disease_id", "canonical_disease_id", "ordo_id") if c in rows.columns]
    return F.coalesce(*[F.nullif(stripped(F.col(c).cast("string")), F.lit("")) for c in names])


def flatten(rankings: DataFrame) -> DataFrame:
    """Results of all methods in one list for each patient, the best score first."""
    order = Window.partitionBy("patient_id").orderBy(F.round("score", DIGITS).desc(), "method", "disease_id")
    return rankings.withColumn("place", F.row_number().over(order))


def by_method(rankings: DataFrame, k: int = 10) -> DataFrame:
    """``patient_id, results``: a map from method to its first k results, best first."""
    item = F.struct("rank", "disease_id", "score")
    listed = rankings.where(F.col("rank") <= k).groupBy("patient_id", "method").agg(F.array_sort(F.collect_list(item)).alias("r"))
    return listed.groupBy("patient_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "r")))).alias("results"))
