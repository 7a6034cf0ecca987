"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows get dense global numbers in a fixed order; a keyed Feistel network over the
smallest power of two that holds them, walked along its cycle until the value is
again a row number, permutes them.  ``shard = p % shards`` and ``slot = p //
shards`` then follow from the number alone, counts of shards differ by one at
most, and :func:`inverse` finds the row of any shard and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

ROUNDS = 8  # even: the halves are back in place


def _round(half: np.ndarray, key: int, width: int) -> np.ndarray:
    x = half + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) & np.uint64((1 << width) - 1)


def _keys(seed: int) -> list[int]:
    return [((seed * 2 + 1) * 0x9E3779B97F4A7C15 * (r + 1) + r) % (1 << 64) for r in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    a, b = bits // 2, bits - bits // 2
    left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
    keys = _keys(seed)
    if not back:
        for r in range(ROUNDS):
            width = a if r % 2 == 0 else b
            left, right = right, left ^ _round(right, keys[r], width)
    else:
        for r in reversed(range(ROUNDS)):
            width = a if r % 2 == 0 else b
            left, right = right ^ _round(left, keys[r], width), left
    return (left << np.uint64(b)) | right


def permute(numbers, total: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0 .. total-1 at ``numbers`` (its inverse if ``back``)."""
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if total <= 1:
        return x
    bits = max(2, (total - 1).bit_length())
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _network(x[todo], bits, seed, back)
        todo = todo[x[todo] >= total]
    return x


def inverse(shard: int, slot: int, shards: int, total: int, seed: int = 0) -> int:
    """The global row number that has this shard and slot."""
    return int(permute([slot * shards + shard], total, seed, back=True)[0])


def number_rows(rows: DataFrame, order: list[Column | str], name: str = "row_no") -> tuple[DataFrame, int]:
    """``rows`` with dense numbers from 0 in the given order, and their count.

    Rows are range-partitioned and sorted, written to the shared folder, and a
    task's rows are numbered from the sum of the earlier tasks' counts.  The
    driver holds one count for each task.  Rows equal in every key may swap
    numbers; a position in the input as last key spreads them over tasks.
    """
    at = f"_{name}_at"
    spread = rows.withColumn(f"_{name}_tie", F.monotonically_increasing_id())
    keys = [*order, F.col(f"_{name}_tie")]
    sorted_rows = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(f"_{name}_tie")
    kept = materialize(sorted_rows.withColumn(at, F.monotonically_increasing_id()), "numbered")
    task, place = F.shiftrightunsigned(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in kept.groupBy(task.alias("task")).count().collect())
    starts, total = [], 0
    for task_id, count in counts:
        starts.append((task_id, total))
        total += count
    spark = rows.sparkSession
    offsets = spark.createDataFrame(starts, "_task long, _start long")  # one row for each task
    out = kept.withColumn("_task", task).join(F.broadcast(offsets), "_task").withColumn(name, F.col("_start") + place)
    return out.drop("_task", "_start", at), total


def shard(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Rows law: every row's shard and slot, counts of shards at most one apart.

    Columns doc_id, size (UTF-8 bytes of the text, null: none, plus 16),
    text_crc32, row_no, law, shard, slot, grown_shard (null: the permutation
    depends on the number of rows, not on keys).  Numbers follow doc_id (null
    first), then the text's checksums, so reruns and other partitionings agree;
    rows equal in all of these may swap places.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text")).alias("_h"),
    )
    numbered, total = number_rows(rows, ["doc_id", "text_crc32", "_h", "size"])

    @F.pandas_udf("long")
    def place(n: pd.Series) -> pd.Series:
        return pd.Series(permute(n.to_numpy(), total, seed).astype(np.int64))

    return numbered.withColumn("_p", place("row_no")).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.expr(f"_p div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )
