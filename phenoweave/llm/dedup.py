"""Exact deduplication by an extendible-hash index on shared files.

Texts are compared without white space.  A slot of the index holds one text: its
key is a 64-bit hash, and texts of one hash are chained and told apart by their
bytes.  Copies are combined before each shuffle, so a large group costs one row
for each task.  A slot knows the row that stays for its text and how many rows
have it.

A directory of hash prefixes finds the bucket of a key.  A bucket that holds more
slots than its capacity is split by one more bit, and the directory doubles as
long as that is needed; it is a table with a row for each cell in use.  Each
writing task owns a range of buckets.  Rows find their slot by bucket, hash and
place in the chain.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import lookup, materialize, placed, remove, unused

SPACE = r"[\x20\x09-\x0D]+"
CAPACITY = 4096  # slots of a bucket
BITS = 62  # hash bits that a directory can use


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def _cell(bits: int | Column) -> Column:
    """The last ``bits`` bits of the hash."""
    mask = F.lit((1 << bits) - 1) if isinstance(bits, int) else F.expr("shiftleft(1L, _depth) - 1")
    return F.col("hash").bitwiseAND(mask)


def directory(slots: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """``cell, bucket, local_depth`` of every cell in use, and the depth of the cells.

    A bucket is the shallowest prefix with ``capacity`` slots at most.  The depth
    grows until all buckets fit; slots of one hash can't be split and share a
    bucket of the greatest depth.
    """
    n = slots.count()
    depth = min(BITS, max(1, (n // capacity).bit_length() + 4))
    while True:
        cells = slots.groupBy(_cell(depth).alias("hash")).agg(F.count("*").alias("n"))
        if depth == BITS or not cells.where(F.col("n") > capacity).limit(1).count():
            break
        depth = min(BITS, 2 * depth)
    every = cells.withColumn("_depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    counted = every.groupBy("_depth", _cell(F.col("_depth")).alias("prefix")).agg(F.sum("n").alias("n"))
    fits = every.withColumn("prefix", _cell(F.col("_depth"))).drop("n").join(counted, ["_depth", "prefix"]).where((F.col("n") <= capacity) | (F.col("_depth") == depth))
    best = fits.groupBy("hash").agg(F.min("_depth").alias("local_depth"))
    out = best.select(F.col("hash").alias("cell"), _cell_at("local_depth").alias("bucket"), F.col("local_depth").cast("int"))
    return materialize(out, "dedup-directory"), depth


def _cell_at(depth: str) -> Column:
    return F.col("hash").bitwiseAND(F.expr(f"shiftleft(1L, {depth}) - 1"))


def build_index(rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The written index of ``rows (hash, norm, rank)``, its directory and the directory's depth.

    Index columns bucket, local_depth, hash, chain, sha, bytes, size, best.
    ``chain`` counts the texts of one hash from 0; ``best`` is the least rank.
    """
    slots = rows.groupBy("hash", "norm").agg(F.min("rank").alias("best"), F.count("*").alias("size"))  # compares bytes
    slots = materialize(slots.select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("bytes"), "size", "best"), "dedup-slots")
    cells, depth = directory(slots, capacity)
    found = slots.withColumn("cell", _cell(depth)).join(cells, "cell").drop("cell")
    owned = found.repartitionByRange("bucket", "hash").sortWithinPartitions("bucket", "hash", "sha")
    chained = owned.withColumn("chain", (F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("sha")) - 1).cast("int"))
    index = materialize(chained.select("bucket", "local_depth", "hash", "chain", "sha", "bytes", "size", "best"), "dedup-index")
    remove(slots, rows.sparkSession)
    return index, cells, depth


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, hashed=F.xxhash64) -> DataFrame:
    """Every row of ``docs`` with the row that stays for its text.

    Columns doc_id, keep_id, group_size, kept, text_sha256, place (the row's
    number in the written key table).  Texts are equal if they are identical
    without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty.  The row with
    the most code points in the original text stays, then the smallest doc_id;
    a null doc_id comes last.  Of rows equal in all that just one is ``kept``.
    doc_id has any type that can be ordered.  Other columns are not read; an
    empty table gives no rows.
    """
    return _decisions(docs.select("doc_id", "text"), F.monotonically_increasing_id(), capacity, hashed)


def _decisions(docs: DataFrame, place: Column, capacity: int, hashed=F.xxhash64) -> DataFrame:
    norm = normalised()
    points = F.char_length(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", place.alias("place"), points.alias("points"), norm.alias("norm"))
    rows = materialize(rows.select("doc_id", "place", "points", hashed("norm").alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm"), "dedup-rows")
    rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("place").alias("at"))
    index, cells, depth = build_index(rows.select("hash", "norm", rank.alias("rank")), capacity)
    keys = materialize(rows.select("doc_id", "place", "hash", "sha"), "dedup-keys")
    remove(rows, docs.sparkSession)  # the texts aren't needed any more
    # a row's bucket by the directory, its slot by hash, its place in the chain by digest
    keyed = keys.select("*", _cell(depth).alias("cell")).join(cells.select("cell", "bucket"), "cell").drop("cell")
    slots = index.where("size > 1").select("bucket", "hash", "sha", "size", F.col("best.d").alias("keep"), F.col("best.at").alias("first"))
    out = lookup(keyed, slots, ["bucket", "hash", "sha"], "size")
    single = F.col("size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("place") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "place",
    )


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, columns unchanged.

    Only names of the rows to drop are joined back.  Rows may repeat; columns of
    any name are carried as they are.
    """
    place = unused(docs, "place")
    rows = placed(docs, place)
    gone = _decisions(rows.select("doc_id", "text", place), F.col(place), capacity).where("not kept").select(F.col("place").alias(place))
    return rows.join(gone, place, "left_anti").select(*docs.columns)
