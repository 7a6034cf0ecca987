"""Building canonical profiles: merged annotations, aliases, mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_annotations(records: DataFrame) -> DataFrame:
    """One row for each (disease_id, term): best positive record, sources, negative flag.

    The best record has the highest source priority, then frequency rank, and is
    the first of equals.  A group without a positive record is a negative term.
    """
    positive = F.coalesce(F.col("qualifier") != "NOT", F.lit(True))
    order = F.struct("source_priority", "frequency_rank", (-F.col("ord")).alias("o"))
    best = F.max(F.when(positive, order))
    return records.groupBy("disease_id", "term").agg(
        best.alias("b"), F.count_distinct("source_priority").alias("n_sources"),
        F.bool_or(~positive).alias("has_negative"), F.count_if(positive).alias("n_positive"),
    ).select(
        "disease_id", "term", F.col("b.source_priority").alias("source_priority"), F.col("b.frequency_rank").alias("frequency_rank"),
        (-F.col("b.o")).alias("ord"), "n_sources", "has_negative", (F.col("n_positive") == 0).alias("negative_term"),
    )


def source_counts(records: DataFrame) -> DataFrame:
    """Rows of each source, and of all (null)."""
    return records.rollup("source_priority").agg(F.count("*").alias("n"))


def canonical_profiles(profile: DataFrame, alias: DataFrame) -> DataFrame:
    """Terms of all aliases under the canonical id; ids without alias are their own."""
    j = profile.join(alias, profile["disease_id"] == alias["alias_id"], "left")
    return j.select(F.coalesce("canonical_id", "disease_id").alias("disease_id"), "term").distinct()


def expand_aliases(canonical: DataFrame, alias: DataFrame) -> DataFrame:
    """Canonical rows, and a copy of them for each alias."""
    copies = canonical.join(alias.where("alias_id <> canonical_id"), canonical["disease_id"] == alias["canonical_id"])
    own = canonical.select("disease_id", "term", F.col("disease_id").alias("canonical_id"))
    return own.unionByName(copies.select(F.col("alias_id").alias("disease_id"), "term", "canonical_id"))


def mapping_index(pairs: DataFrame) -> DataFrame:
    """``id, target``: the last written target of each id by (source_ord, row_ord), the greatest of equals."""
    return pairs.groupBy("id").agg(F.max(F.struct("source_ord", "row_ord", "target")).alias("x")).select("id", "x.target")
