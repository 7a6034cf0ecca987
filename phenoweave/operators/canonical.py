"""From source records and metadata to canonical profiles.

Metadata rows are ``source, source_ord, ord, local_id, id, label, description,
xrefs, exact_matches, profile_type``; sources count in the order of source_ord
(ORDO 1, MONDO 2, HOOM 3), rows of one source by ord.  Annotation rows are
``ord, raw_id, name, term, frequency, source``.  Everything that the sources
overwrite in turn is one aggregate by the greatest position here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids


def _last(value: str | Column, when: Column | None = None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    place = F.struct("source_ord", "ord", v.alias("v"))
    return F.max(place if when is None else F.when(when, place))["v"]


def metadata_lookup(meta: DataFrame) -> DataFrame:
    """``id, xrefs, label, description, profile_type``: the last row of each id."""
    place = F.struct("source_ord", "ord")
    last = meta.where(F.col("id").rlike(r"\S")).groupBy("id").agg(F.max_by(F.struct("xrefs", "label", "description", "profile_type"), place).alias("m"))
    return last.select("id", "m.*")


def mapping_from_metadata(meta: DataFrame) -> DataFrame:
    """``id, target``: other identifiers of the Orphanet diseases that the metadata names.

    MONDO rows count by exact match only; other sources by exact match, then by
    cross reference.  The last row that maps an identifier wins.
    """
    exact = ids.orpha_in_matches(F.col("exact_matches"))
    target = F.when(F.col("id").startswith("ORPHA:"), F.col("id")).when(F.col("source") == "MONDO", exact).otherwise(F.coalesce(exact, ids.first_orpha(F.col("xrefs"))))
    mondo = F.when(F.col("source") != "MONDO", ids.identifiers_in(F.col("xrefs"), "MONDO")).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array("id"), ids.identifiers_in(F.col("xrefs"), "OMIM"), mondo)
    found = meta.withColumn("target", target).where("target is not null").select("source_ord", "ord", "id", "target", F.explode(names).alias("name"))
    found = found.where((F.col("name") != F.col("id")) | (F.col("name") != F.col("target")))
    return found.groupBy(F.col("name").alias("id")).agg(_last("target").alias("target"))


def resolve(rows: DataFrame, mapping: DataFrame, meta: DataFrame, raw: str = "raw_id") -> DataFrame:
    """``rows`` with canonical_id: an ORPHA id is its own, then the mapping, then the metadata's cross reference, then itself."""
    by_meta = metadata_lookup(meta).select(F.col("id").alias(raw), ids.first_orpha(F.col("xrefs")).alias("_xref"))
    joined = rows.join(mapping.select(F.col("id").alias(raw), F.col("target").alias("_target")), raw, "left").join(by_meta, raw, "left")
    own = F.when(F.col(raw).startswith("ORPHA:"), F.col(raw))
    return joined.withColumn("canonical_id", F.coalesce(own, "_target", "_xref", raw)).drop("_target", "_xref")


def labelled_annotations(annotations: DataFrame, labels: DataFrame) -> DataFrame:
    """Annotations with a disease and a term that has a label."""
    return annotations.where("raw_id is not null and term is not null").join(labels.select("term"), "term", "left_semi")


def fold(annotations: DataFrame, meta: DataFrame, mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each canonical id.

    label (of the first record, or the id), ordo_label, mondo_label, hoom_label,
    the three descriptions (of each source's last row), merged_description,
    profile_type, canonicalized (some record had another id), source_ids (map of
    the last values by key), n_records.
    """
    notes = resolve(labelled_annotations(annotations, labels), mapping, meta)
    source = F.lower(F.coalesce(F.nullif(ids.stripped(F.col("source")), F.lit("")), F.lit("UNKNOWN")))
    notes = notes.select(
        "canonical_id", "raw_id", F.lit(0).alias("source_ord"), "ord", F.lit(None).cast("string").alias("source"), F.col("name").alias("label"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("profile_type"),
        F.array(F.struct(F.concat(source, F.lit("_original_id")).alias("k"), F.col("raw_id").alias("v")), F.struct(F.concat(source, F.lit("_frequency_codes")).alias("k"), F.col("frequency").alias("v"))).alias("given"),
    )
    own = resolve(meta.withColumnRenamed("id", "raw_id"), mapping, meta)
    prefix = F.lower("source")
    own = own.select(
        "canonical_id", "raw_id", "source_ord", "ord", "source", "label", "description", "profile_type",
        F.array(F.struct(F.concat(prefix, F.lit("_id")).alias("k"), F.col("raw_id").alias("v")), F.struct(F.concat(prefix, F.lit("_local_id")).alias("k"), F.col("local_id").alias("v"))).alias("given"),
    )
    text = lambda c: F.nullif(ids.stripped(F.col(c)), F.lit(""))
    rows = notes.unionByName(own).withColumns({c: text(c) for c in ("label", "description", "profile_type")})
    first = F.min(F.struct("source_ord", "ord", "label"))["label"]
    per_source = [_last(c, F.col("source") == s).alias(f"{s.lower()}_{c}") for s in ("ORDO", "MONDO", "HOOM") for c in ("label", "description")]
    folded = rows.groupBy("canonical_id").agg(
        F.coalesce(first, "canonical_id").alias("label"), *per_source,
        _last("profile_type", (F.col("source") == "ORDO") & F.col("profile_type").isNotNull()).alias("profile_type"),
        F.bool_or(F.col("canonical_id") != F.col("raw_id")).alias("canonicalized"), F.count("*").alias("n_records"),
    )
    given = rows.select("canonical_id", "source_ord", "ord", F.explode("given").alias("g")).where("g.v is not null and g.v <> ''")
    given = given.groupBy("canonical_id", F.col("g.k").alias("k")).agg(_last(F.col("g.v")).alias("v"))
    given = given.groupBy("canonical_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("source_ids"))  # a few keys for each source
    merged = F.coalesce("ordo_description", "mondo_description", "hoom_description")
    return folded.withColumn("merged_description", merged).join(given, "canonical_id", "left")


def aliases(annotations: DataFrame, meta: DataFrame, mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """``alias_id, canonical_id`` of every identifier that records or metadata use."""
    used = labelled_annotations(annotations, labels).select("raw_id").unionByName(meta.select(F.col("id").alias("raw_id"))).distinct()
    return resolve(used, mapping, meta).select(F.col("raw_id").alias("alias_id"), "canonical_id")


def source_id_index(folded: DataFrame) -> DataFrame:
    """``id, canonical_id``: every identifier that safely names a profile."""
    own = folded.select(F.col("canonical_id").alias("id"), "canonical_id")
    linked = folded.select("canonical_id", F.explode("source_ids").alias("k", "id")).where(ids.is_linkable(F.col("k"), F.col("id"))).select("id", "canonical_id")
    return own.unionByName(linked).distinct()


def matched_aliases(folded: DataFrame, alias: DataFrame) -> DataFrame:
    """``canonical_id, alias_id``: normalised identifiers of a profile: its own, its sources' and its aliases."""
    own = folded.select("canonical_id", F.col("canonical_id").alias("a"))
    given = folded.select("canonical_id", F.explode("source_ids").alias("k", "a")).drop("k")
    every = own.unionByName(given).unionByName(alias.select("canonical_id", F.col("alias_id").alias("a")))
    return every.select("canonical_id", ids.normalize_disease_id(F.col("a")).alias("alias_id")).where("alias_id is not null").distinct()


def category_source(names: DataFrame, with_path: DataFrame) -> DataFrame:
    """``canonical_id, source_id``: the identifier whose path is shown; ``with_path (id)`` have one.

    The profile itself comes first, then its least ORPHA alias, then its least alias.
    """
    open_ = names.join(with_path.select(F.col("id").alias("alias_id")).distinct(), "alias_id", "left_semi")
    kind = F.when(F.col("alias_id") == F.col("canonical_id"), 0).when(F.col("alias_id").startswith("ORPHA:"), 1).otherwise(2)
    return open_.groupBy("canonical_id").agg(F.min(F.struct(kind.alias("kind"), "alias_id"))["alias_id"].alias("source_id"))


def equivalents(alias: DataFrame) -> DataFrame:
    """``id, other``: all identifiers that the alias map makes equal, each with itself.

    An identifier equals its canonical one, and whatever maps to either.
    """
    links = alias.select(F.col("alias_id").alias("id"), F.col("canonical_id").alias("other"))
    both = links.unionByName(links.select(F.col("other").alias("id"), F.col("id").alias("other")))
    every = both.unionByName(both.select("id", F.col("id").alias("other"))).distinct()
    # those of the canonical identifier as well
    through = links.join(every.select(F.col("id").alias("c"), F.col("other").alias("o")), F.col("other") == F.col("c")).select("id", F.col("o").alias("other"))
    return every.unionByName(through).distinct()


def valid_profiles(folded: DataFrame, terms: DataFrame) -> DataFrame:
    """Profiles with a term or a description that isn't blank."""
    has = terms.select("canonical_id").distinct().withColumn("_has", F.lit(True))
    return folded.join(has, "canonical_id", "left").where(F.coalesce("_has", F.lit(False)) | F.coalesce(F.col("merged_description").rlike(r"\S"), F.lit(False))).drop("_has")
