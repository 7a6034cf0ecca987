"""Readers of annotations in axioms, tables of other tools and whole artifact folders."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import Context, allowed
from .readers import _whole

# fixed values: names in the axiom file and in spreadsheets
AXIOM = r"(?i)Orpha:(\d+)_HP:(\d+)_Freq:([A-Za-z0-9%]+)"
_AXIOMS = (
    "Class array<struct<_IRI:string>>, ObjectIntersectionOf array<struct<ObjectSomeValuesFrom:"
    "array<struct<ObjectProperty:struct<_IRI:string>,Class:struct<_IRI:string>>>>>"
)
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Tables of an artifact folder by the names that :func:`load_context` takes them by.
ARTIFACTS = ("profile", "profile_term", "edge", "label", "text", "negative", "excluded")


def axiom_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations in the names of equivalent classes; the first frequency in their axioms wins over the name's.

    Rows without such a name are dropped, equal ones are one.
    """
    d = spark.read.format("xml").option("rowTag", "EquivalentClasses").schema(_AXIOMS).load(path)
    iri = F.get("Class", F.lit(0))["_IRI"]
    part = lambda i: F.regexp_extract(iri, AXIOM, i)
    some = F.flatten(F.transform(F.coalesce("ObjectIntersectionOf", F.array().cast(d.schema["ObjectIntersectionOf"].dataType)), lambda x: F.coalesce(x["ObjectSomeValuesFrom"], F.array())))
    given = F.get(F.filter(some, lambda x: x["ObjectProperty"]["_IRI"] == "#has_frequency"), F.lit(0))["Class"]["_IRI"]
    named = F.nullif(F.trim(F.regexp_replace(given, "^#+", "")), F.lit(""))
    disease = F.concat(F.lit("ORPHA:"), part(1))
    rows = d.where(iri.rlike(AXIOM)).select(
        disease.alias("database_id"), disease.alias("disease_name"), F.lit("").alias("qualifier"),
        F.concat(F.lit("HP:"), F.when(F.length(part(2)) < 7, F.lpad(part(2), 7, "0")).otherwise(part(2))).alias("hpo_id"), F.coalesce(named, F.upper(part(3))).alias("frequency_code"), F.lit("HOOM").alias("source"),
    )
    return rows.dropDuplicates(["database_id", "hpo_id", "frequency_code"])


def delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A table with a header; without ``separator`` it is a tab if the first line has one, else a comma."""
    if separator is None:
        first = spark.read.text(path).limit(1).collect()
        separator = "\t" if first and "\t" in first[0][0] else ","
    return spark.read.option("sep", separator).option("header", True).option("multiLine", True).csv(path)


def _cells(raw: bytes) -> list[list[str]]:
    """Rows of the first sheet as text; blank rows are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(SHEET + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(SHEET + "si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(SHEET + "row") if sheets else ():
            cells: dict[int, str] = {}
            for at, c in enumerate(row.iter(SHEET + "c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group()))) - 1 if letters else at
                value = c.find(SHEET + "v")
                text = "".join(t.text or "" for t in c.iter(SHEET + "t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                cells[column] = shared[int(text)] if c.get("t") == "s" and text else text
            if any(cells.values()):
                out.append([cells.get(i, "") for i in range(max(cells) + 1)])
        return out


def spreadsheets(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, cells`` (map from header to text) of the first sheet of each workbook."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["file"], batch["content"], strict=True):
                head, *rows = _cells(raw) or [[]]
                maps = [{h.strip(): v for h, v in zip(head, r + [""] * len(head), strict=False) if h.strip()} for r in rows]
                yield pd.DataFrame({"file": [name] * len(maps), "row_no": range(len(maps)), "cells": maps})

    return files.mapInPandas(run, "file string, row_no long, cells map<string,string>")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``file, key, value`` of JSON objects that map keys to values of the DDL type ``value``."""
    return _whole(spark, path).select(F.col("dataset").alias("file"), F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def metric_json(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, label, recall_1, recall_10, mrr, seconds`` of evaluation files, a row for each method."""
    schema = "dataset string, method_metrics map<string,struct<recall_1:double,recall_10:double,mrr:double,ndcg:double>>, method_avg_seconds map<string,double>"
    d = _whole(spark, path).select(F.col("dataset").alias("file"), F.from_json("value", schema).alias("j"))
    rows = d.select(F.coalesce("j.dataset", "file").alias("dataset"), "j.method_avg_seconds", F.explode("j.method_metrics").alias("label", "m"))
    return rows.select("dataset", "label", "m.recall_1", "m.recall_10", "m.mrr", F.try_element_at("method_avg_seconds", F.col("label")).alias("seconds"))


def _listed(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(f.getPath()) for f in (found or []))


def datasets(spark: SparkSession, folder: str, wanted: list[str] | None = None) -> tuple[dict[str, str], list[str]]:
    """Case files of a folder by name, whatever the request's case, and the names that have none."""
    every = {PurePosixPath(p).stem: p for p in _listed(spark, f"{folder}/*.json")}
    if wanted is None:
        return every, []
    found, missing = allowed(wanted, list(every))
    return {n: every[n] for n in found}, missing


def benchmarks(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Summary files by tool: ``<tool>_benchmarks/<dataset>_summary.tsv``."""
    out: dict[str, list[str]] = {}
    for p in _listed(spark, f"{folder}/*_benchmarks/*_summary.tsv"):
        path = PurePosixPath(p)
        out.setdefault(path.parent.name.removesuffix("_benchmarks"), []).append(path.stem.removesuffix("_summary"))
    return out


def load_context(spark: SparkSession, folder: str, **options) -> Context:
    """The context from the Parquet tables of an artifact folder; tables that aren't there stay unset."""
    present = {PurePosixPath(p).stem: p for p in _listed(spark, f"{folder}/*.parquet")}
    missing = [n for n in ARTIFACTS[:3] if n not in present]
    if missing:
        raise ValueError(f"{folder} lacks {missing}")
    return Context(**{n: spark.read.parquet(present[n]) for n in ARTIFACTS if n in present}, **options)


def write_context(context: Context, folder: str) -> None:
    """All tables of the context as Parquet, and what it was asked to make."""
    for n in ARTIFACTS:
        table = getattr(context, n)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{n}.parquet")
    for n in ("ancestors", "ic"):
        getattr(context, n).write.mode("overwrite").parquet(f"{folder}/{n}.parquet")


def unknown_terms(patients: DataFrame, labels: DataFrame) -> DataFrame:
    """Terms of patients that have no label."""
    return patients.join(labels.select("term"), "term", "left_anti")


def with_extraction(patients: DataFrame, extract) -> DataFrame:
    """``patient_id, term`` of patient rows; those without terms get what ``extract(patient_id, text)`` finds in their text.

    A patient with neither raises when it is read.
    """
    none = F.coalesce(F.size("hpo_terms"), F.lit(0)) <= 0
    lost = none & ~F.coalesce(F.col("raw_text").rlike(r"\S"), F.lit(False))
    stop = F.raise_error(F.concat(F.lit("neither terms nor text: "), F.coalesce("patient_id", F.lit("?")))).cast("string")
    checked = patients.withColumn("patient_id", F.when(lost, stop).otherwise(F.col("patient_id")))
    own = checked.where(~none).select("patient_id", F.explode("hpo_terms").alias("term"))
    texts = checked.where(none).select("patient_id", F.col("raw_text").alias("text"))
    return own.unionByName(extract(texts, "patient_id").select("patient_id", "term").distinct())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def text_report(metrics: DataFrame) -> str:
    """A fixed-width table of a method's recall, rank and time a line, the best first, with a bar."""
    rows = metrics.orderBy(F.desc("recall_10"), F.desc("mrr"), "method").collect()  # a row for each method
    wide = max([len(str(r["method"])) for r in rows] + [6])
    lines = [f"{'method':<{wide}}  {'R@1':>6} {'R@10':>6} {'MRR':>6}"]
    for r in rows:
        bar = "#" * round(20 * (r["recall_10"] or 0))
        lines.append(f"{r['method']:<{wide}}  {r['recall_1']:>6.3f} {r['recall_10']:>6.3f} {r['mrr']:>6.3f} {bar}")
    return "\n".join(lines) + "\n"


def html_report(tables: dict[str, DataFrame], title: str = "Evaluation") -> str:
    """A page with a table for each small DataFrame; all text is escaped."""
    from html import escape

    parts = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(parts)


def phenopacket(patient_id: str, terms: list[str], labels: dict[str, str], methods: list[str], results: list[dict], created: str) -> str:
    """A patient in the exchange format, with the first five results."""
    features = [{"type": {"id": t, "label": labels.get(t, t)}} for t in terms]
    top = [{k: r.get(k) for k in ("disease_id", "label", "score")} for r in results[:5]]
    resource = {"id": "hp", "name": "Human Phenotype Ontology", "namespacePrefix": "HP"}
    data = {"id": patient_id, "subject": {"id": patient_id}, "phenotypicFeatures": features, "metaData": {"created": created, "resources": [resource], "ranking": {"methods_used": methods, "top_results": top}}}
    return json.dumps(data, indent=2, ensure_ascii=False)


def write_vectors(vectors: DataFrame, texts: DataFrame, path: str) -> str:
    """Embeddings as Parquet beside the fingerprint of the texts they were made of; the fingerprint."""
    mark = fingerprint(texts)
    vectors.withColumn("fingerprint", F.lit(mark)).write.mode("overwrite").parquet(path)
    return mark


def read_vectors(spark: SparkSession, texts: DataFrame, path: str) -> DataFrame | None:
    """The written embeddings, or None if they were made of other texts."""
    if not _listed(spark, path):
        return None
    stored = spark.read.parquet(path)
    first = stored.select("fingerprint").limit(1).collect()
    return stored.drop("fingerprint") if first and first[0][0] == fingerprint(texts) else None


def fingerprint(texts: DataFrame) -> str:
    """A digest of all ``id, text`` rows that doesn't depend on their order, made without gathering them."""
    row = F.sha2(F.concat_ws("\0", F.col("id").cast("string"), F.coalesce("text", F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = texts.agg(F.count("*").alias("n"), *parts).first()
    import hashlib

    return hashlib.sha256("|".join(str(x) for x in sums).encode()).hexdigest()
