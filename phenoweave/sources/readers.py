"""Readers of ontology, annotation, case and result files.

Each reader declares its schema, so no file is read twice, and returns a lazy
DataFrame.  Rows that lack a required field are dropped where the docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import normalize_disease_id, normalize_frequency, normalize_term_id

# fixed values: element names of the file formats
_VALUES = "array<struct<_VALUE:string,`_xml:lang`:string>>"
_CLASS = (
    "`_rdf:about` string, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>,"
    f" `rdfs:label` {_VALUES}, `obo:IAO_0000115` {_VALUES}, `rdfs:comment` {_VALUES}, `skos:notation` {_VALUES},"
    f" `oboInOwl:hasDbXref` {_VALUES}, `skos:exactMatch` array<struct<`_rdf:resource`:string>>"
)
_DISORDER = (
    "OrphaCode string, HPODisorderAssociationList struct<HPODisorderAssociation:"
    "array<struct<HPO:struct<HPOId:string>,HPOFrequency:struct<Name:struct<_VALUE:string,_lang:string>>>>>"
)
_PATIENT = "patient_id string, raw_text string, hpo_terms array<string>, propagated_hpo_terms array<string>, excluded_hpo_terms array<string>"
MONARCH_PREFIXES = ("MONDO", "OMIM", "ORPHA", "DECIPHER", "DOID")


def last_segment(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^/#]*)[/#]*$", 1)


def _clean(values: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(f"`{values}`"), F.array()), lambda v: F.trim(v["_VALUE"])), lambda v: v != "")


def owl_classes(spark: SparkSession, path: str, prefixes: tuple[str, ...]) -> DataFrame:
    """``owl:Class`` elements whose name contains one of the prefixes.

    Columns local_id, uri, normalized_id, label, description, xrefs, exact_matches,
    notations, parents (local ids with such a prefix).  The description is the
    definition, else the comment.  Unnamed classes have no uri and are dropped.
    """
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(_CLASS).load(path)
    named = lambda c: F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: c.contains(p))
    resources = lambda name: F.filter(F.transform(F.coalesce(F.col(f"`{name}`"), F.array()), lambda v: v["_rdf:resource"]), lambda v: v.isNotNull())
    uri = F.col("`_rdf:about`")
    return rows.where(named(uri)).select(
        last_segment(uri).alias("local_id"), uri.alias("uri"), normalize_disease_id(last_segment(uri)).alias("normalized_id"),
        F.get(_clean("rdfs:label"), F.lit(0)).alias("label"),
        F.coalesce(F.get(_clean("obo:IAO_0000115"), F.lit(0)), F.get(_clean("rdfs:comment"), F.lit(0))).alias("description"),
        _clean("oboInOwl:hasDbXref").alias("xrefs"), F.array_distinct(resources("skos:exactMatch")).alias("exact_matches"),
        _clean("skos:notation").alias("notations"),
        F.transform(F.filter(resources("rdfs:subClassOf"), named), last_segment).alias("parents"),
    )


def phenotype_terms(spark: SparkSession, path: str) -> DataFrame:
    """``term, label, parents`` of the phenotype ontology, ids with a colon."""
    colon = lambda c: F.translate(c, "_", ":")
    return owl_classes(spark, path, ("HP_",)).select(colon(F.col("local_id")).alias("term"), "label", F.transform("parents", colon).alias("parents"))


def disease_edges(spark: SparkSession, path: str) -> DataFrame:
    """``child, parent`` between numbered rare-disease classes; a class without parents has a null parent."""
    d = owl_classes(spark, path, ("Orphanet_",)).where(F.col("local_id").rlike(r"^Orphanet_\d+$"))
    up = F.filter("parents", lambda p: p.rlike(r"^Orphanet_\d+$"))
    return d.select(F.col("normalized_id").alias("child"), F.explode_outer(up).alias("p")).select("child", normalize_disease_id(F.col("p")).alias("parent"))


def _tsv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    return (r.option("comment", comment) if comment else r).csv(path)


def _optional(df: DataFrame, *names: str) -> Column:
    """First present of the columns, else null."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def annotations_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows after ``#`` lines and a header; rows without disease or term are dropped."""
    d = _tsv(spark, path, "#")
    return d.select(
        F.trim("database_id").alias("database_id"), _optional(d, "disease_name").alias("disease_name"), _optional(d, "qualifier").alias("qualifier"),
        F.trim("hpo_id").alias("hpo_id"), F.nullif(F.trim(_optional(d, "frequency")), F.lit("")).alias("frequency_code"), F.lit("HPOA").alias("source"),
    ).where("coalesce(database_id, '') <> '' AND coalesce(hpo_id, '') <> ''")


def associations_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Association rows (plain or gzip) of diseases with known prefixes and phenotype terms, distinct."""
    d = _tsv(spark, path)
    prefix = F.split(F.col("subject"), ":")[0]
    kept = d.where(F.col("object").startswith("HP:") & prefix.isin(*MONARCH_PREFIXES))
    name = _optional(d, "subject_label")
    negated = F.lower(F.coalesce(_optional(d, "negated"), F.lit(""))) == "true"
    return kept.select(
        F.col("subject").alias("database_id"), name.alias("disease_name"), F.when(negated, "NOT").alias("qualifier"), F.col("object").alias("hpo_id"),
        normalize_frequency(_optional(d, "frequency_qualifier_label", "frequency_qualifier")).alias("frequency_code"), F.lit("MONARCH").alias("source"),
    ).dropDuplicates(["database_id", "hpo_id", "qualifier"])


def disorder_xml(spark: SparkSession, path: str) -> DataFrame:
    """Phenotypes of numbered disorders with their frequency, distinct."""
    d = spark.read.format("xml").option("rowTag", "Disorder").schema(_DISORDER).load(path).where(F.col("OrphaCode").rlike(r"^\s*\d+\s*$"))
    a = d.select(F.concat(F.lit("ORPHA:"), F.trim("OrphaCode")).alias("database_id"), F.explode("HPODisorderAssociationList.HPODisorderAssociation").alias("a"))
    return a.select(
        "database_id", normalize_term_id(F.col("a.HPO.HPOId")).alias("hpo_id"), normalize_frequency(F.col("a.HPOFrequency.Name._VALUE")).alias("frequency_code"), F.lit("ORPHADATA").alias("source"),
    ).where("hpo_id IS NOT NULL").distinct()


def patients(spark: SparkSession, path: str) -> DataFrame:
    """Patient profiles, one JSON object a file."""
    return spark.read.schema(_PATIENT).option("multiLine", True).json(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("dataset"), F.col("value"))


def term_cases(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``dataset, case_index, hpo_terms, ground_truth`` of ``[[terms], [truth]]`` files.

    With ``strict`` a case without both lists raises; otherwise the missing list is empty.
    """
    d = _whole(spark, path).select("dataset", F.posexplode(F.from_json("value", "array<array<array<string>>>")).alias("case_index", "c"))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not two lists: "), "dataset", F.lit(" case "), F.col("case_index").cast("string")))
        d = d.withColumn("c", F.when((F.size("c") >= 2) & F.get("c", F.lit(0)).isNotNull() & F.get("c", F.lit(1)).isNotNull(), F.col("c")).otherwise(wrong.cast("array<array<string>>")))
    part = lambda i: F.coalesce(F.get("c", F.lit(i)), F.array().cast("array<string>"))
    return d.select("dataset", "case_index", part(0).alias("hpo_terms"), part(1).alias("ground_truth"))


_CASE = "id string, case_id string, raw_text string, text string, clinical_text string, description string, disease_codes array<string>"


def raw_text_cases(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, case_index, case_id, raw_text, ground_truth`` of object lists or of ``{disease: text}`` maps.

    Blank texts are dropped; numbers as disease ids get the rare-disease prefix.
    """
    d = _whole(spark, path).withColumn("is_map", F.ltrim("value").startswith("{"))
    listed = d.where("NOT is_map").select("dataset", F.posexplode(F.from_json("value", f"array<struct<{_CASE.replace(' string', ':string').replace(' array', ':array')}>>")).alias("case_index", "c"))
    text = F.coalesce("c.raw_text", "c.text", "c.clinical_text", "c.description")
    clean = lambda codes: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), normalize_disease_id), lambda x: x.isNotNull())))
    one = listed.select("dataset", "case_index", F.coalesce("c.id", "c.case_id", F.col("case_index").cast("string")).alias("case_id"), text.alias("raw_text"), clean(F.col("c.disease_codes")).alias("ground_truth"))
    mapped = d.where("is_map").select("dataset", F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("case_index", "e"))
    two = mapped.select("dataset", "case_index", F.col("e.key").alias("case_id"), F.col("e.value").alias("raw_text"), clean(F.array(F.col("e.key"))).alias("ground_truth"))
    return one.unionByName(two).where(F.trim(F.coalesce("raw_text", F.lit(""))) != "")


def signed_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with present and excluded terms; each list trimmed, distinct and sorted."""
    fields = "array<struct<hpo_terms:array<string>,excluded_hpo_terms:array<string>,disease_codes:array<string>>>"
    d = _whole(spark, path).select("dataset", F.posexplode(F.from_json("value", fields)).alias("case_index", "c"))
    clean = lambda n: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col(n), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))
    return d.select("dataset", "case_index", clean("c.hpo_terms").alias("hpo_terms"), clean("c.excluded_hpo_terms").alias("excluded_hpo_terms"), clean("c.disease_codes").alias("ground_truth"))


_FEATURE = "struct<excluded:boolean,type:struct<id:string,label:string>>"
_PACKET = (
    f"id string, phenotypicFeatures array<{_FEATURE}>, diseases array<struct<term:struct<id:string>>>,"
    " interpretations array<struct<diagnosis:struct<disease:struct<id:string>>>>"
)


def phenopackets(spark: SparkSession, path: str, mapping: DataFrame | None = None) -> DataFrame:
    """``case_id, hpo_terms, excluded_hpo_terms, ground_truth`` of packets with terms and a disease.

    Diseases come from interpretations, else from the disease list; ``mapping``
    (id, target) adds mapped ids.
    """
    d = spark.read.schema(_PACKET).option("multiLine", True).json(path)
    no = F.array().cast("array<string>")
    ids = lambda c, f: F.filter(F.transform(F.coalesce(F.col(c), F.array()), f), lambda x: x.isNotNull())
    features = F.filter(F.coalesce("phenotypicFeatures", F.array()), lambda x: x["type"]["id"].startswith("HP:"))
    pick = lambda out: F.array_sort(F.array_distinct(F.transform(F.filter(features, lambda x: F.coalesce(x["excluded"], F.lit(False)) == out), lambda x: x["type"]["id"])))
    first = ids("interpretations", lambda x: x["diagnosis"]["disease"]["id"])
    truth = F.when(F.size(first) > 0, first).otherwise(ids("diseases", lambda x: x["term"]["id"]))
    d = d.select(F.coalesce("id", F.col("_metadata.file_name")).alias("case_id"), pick(False).alias("hpo_terms"), pick(True).alias("excluded_hpo_terms"), F.array_sort(F.array_distinct(truth)).alias("ground_truth"))
    d = d.where((F.size("hpo_terms") > 0) & (F.size("ground_truth") > 0))
    if mapping is None:
        return d
    more = d.select("case_id", F.explode("ground_truth").alias("id")).join(mapping, "id").groupBy("case_id").agg(F.collect_set("target").alias("more"))
    return d.join(more, "case_id", "left").withColumn("ground_truth", F.array_sort(F.array_union("ground_truth", F.coalesce("more", no)))).drop("more")


def gene_cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``hpo``, ``orpha`` (one or many) and ``omim``; incomplete lines are dropped."""
    d = spark.read.schema("id string, hpo array<string>, orpha string, omim string").json(path)
    many = F.coalesce(F.from_json("orpha", "array<string>"), F.filter(F.array("orpha"), lambda x: x.isNotNull()))
    truth = F.concat(F.transform(many, lambda x: normalize_disease_id(x)), F.transform(F.filter(F.array("omim"), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("OMIM:"), F.regexp_replace(x, "^OMIM:", ""))))
    return d.select("id", "hpo", F.array_distinct(truth).alias("ground_truth")).where((F.size("hpo") > 0) & (F.size("ground_truth") > 0))


_CACHE = (
    "case_id string, case_index int, hpo_terms array<string>, ground_truth array<string>, raw_text string, excluded_hpo_terms array<string>,"
    " method_elapsed map<string,double>, results map<string,array<struct<disease_id:string,rank:int,score:double>>>"
)


def case_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached results as rows ``case_number, method, disease_id, rank, score, seconds``; unreadable files give none."""
    d = spark.read.schema(_CACHE).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "case_*.json").json(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"case_(\d+)\.json$", 1).cast("int")
    d = d.select(number.alias("case_number"), "method_elapsed", F.explode("results").alias("method", "list"))
    return d.select("case_number", "method", F.element_at("method_elapsed", F.col("method")).alias("seconds"), F.explode("list").alias("r")).select("case_number", "method", "r.disease_id", "r.rank", "r.score", "seconds")


def ranked_tsv(spark: SparkSession, path: str, comment: str = "!") -> DataFrame:
    """``rank, disease_id, score`` of tool output with a header after comment lines; ranks may have thousands commas."""
    d = _tsv(spark, path, comment)
    return d.select(
        F.regexp_replace(_optional(d, "rank", "Rank"), ",", "").cast("int").alias("rank"), normalize_disease_id(_optional(d, "diseaseCurie", "disease_id", "diseaseId")).alias("disease_id"),
        _optional(d, "posttestprob", "posttestProbability", "score").alias("score"),
    ).where("disease_id IS NOT NULL")


def ordered_tsv(spark: SparkSession, path: str, disease_column: int = 2) -> DataFrame:
    """``file, rank, disease_id`` where the order of lines without ``#`` is the rank.

    A file is one ranking and read as one row, so the order is that of the file.
    """
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    kept = d.select("file", F.posexplode(F.filter("lines", lambda x: (F.trim(x) != "") & ~x.startswith("#"))).alias("p", "line"))
    return kept.select("file", (F.col("p") + 1).alias("rank"), normalize_disease_id(F.get(F.split("line", "\t"), F.lit(disease_column))).alias("disease_id"))


def summary_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark summaries, all columns strings, with the dataset taken from the file name."""
    d = _tsv(spark, path)
    return d.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_summary\.tsv$", 1).alias("dataset"), *d.columns)


def newest(rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """One row for each key: the least priority wins (JSON metrics before TSV)."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(priority))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")
