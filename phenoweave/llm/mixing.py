"""Mixing sources to target weights by hash-threshold histograms.

Each row has a fixed hash.  Sizes are summed by source and by the leading hash
bits; the bucket in which a source's running sum crosses its budget is refined
by the next bits, and only that bucket's rows are read again, until one row (or
rows of one hash) is left.  Rows below the threshold are taken once more than the
others: no row is sorted, and a smaller budget always takes a subset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BITS, LEVELS = 12, 5  # of one 60-bit key; two keys make ten levels
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Budget:
    source: str | None
    size: int
    target: float
    repeats: int = 0
    rest: float = 0.0
    prefix: int = 0
    depth: int = 0
    open: bool = False


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Budgets that sum to ``share`` of all sizes, by weight, none above ``most`` times its size.

    What a source can't use goes to the others by weight, until none is above.
    A share beyond ``most`` gives every source ``most`` times its size.
    """
    left, active, out = share * sum(sizes.values()), dict(weights), {}
    while active:
        unit = left / sum(active.values())
        over = [s for s, w in active.items() if unit * w > most * sizes[s]]
        if not over:
            out |= {s: unit * w for s, w in active.items()}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del active[s]
    return out


def cycle_weights(sources: list, cycle: tuple = (5, 2, 1)) -> dict:
    """Weights repeating over the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def mix(docs: DataFrame, weights=cycle_weights, share: float = 1.5, most: float = 2, seed: int = 17, carried: list[str] | None = None) -> DataFrame:
    """Every row with the words that the mix takes of it.

    ``weights`` gives a weight for each source; a mix is configured by source, so
    the driver holds a few numbers for each.  Columns doc_id, source, size,
    source_size, target, taken; ``taken`` is a whole number of times ``size``.
    Null texts have size 0, a null source is a source, rows with equal doc_id and
    text are told apart by their place in the written key table.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    key = lambda h: F.shiftrightunsigned(h, 64 - BITS * LEVELS)
    rows = materialize(
        docs.select(
            "doc_id", "source", *(carried or []), word_count().alias("size"),
            key(F.xxhash64(F.lit(seed), "doc_id", "text")).alias("k1"),
            key(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id())).alias("k2"),
        ),
        "mix",
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    aims = targets(sizes, weights(list(sizes)), share, most) if sizes else {}
    budgets = []
    for s, total in sizes.items():
        b = Budget(s, total, aims[s])
        b.repeats = min(int(b.target // total), int(most)) if total else 0
        b.rest = b.target - b.repeats * total
        b.open = total > 0 and b.rest > 0
        budgets.append(b)
    for level in range(2 * LEVELS):
        if not any(b.open for b in budgets):
            break
        _refine(rows, [b for b in budgets if b.open], level)
    cuts = []
    for b in budgets:
        up = 12 * (LEVELS - b.depth) if b.depth <= LEVELS else 0
        first, second = (b.prefix << up, 0) if b.depth <= LEVELS else divmod(b.prefix << BITS * (2 * LEVELS - b.depth), 1 << BITS * LEVELS)
        cuts.append((b.source, b.size, b.target, b.repeats, first, second))
    plan = spark.createDataFrame(cuts, "_source string, source_size long, target double, _repeats int, _t1 long, _t2 long")
    extra = (F.col("k1") < F.col("_t1")) | ((F.col("k1") == F.col("_t1")) & (F.col("k2") < F.col("_t2")))
    return rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["_source"])).select(
        "doc_id", "source", *(carried or []), "size", "source_size", "target",
        ((F.col("_repeats") + F.when(extra, 1).otherwise(0)) * F.col("size")).cast("long").alias("taken"),
    )


def _refine(rows: DataFrame, budgets: list[Budget], level: int) -> None:
    """One more level of bits in the open sources' boundary buckets."""
    spark = rows.sparkSession
    which, inner = ("k1", level) if level < LEVELS else ("k2", level - LEVELS)
    shift = BITS * (LEVELS - 1 - inner)
    bucket = F.shiftrightunsigned(which, shift).bitwiseAND((1 << BITS) - 1)
    if level:
        low, width = [], BITS * (LEVELS - level) if level < LEVELS else 0
        for b in budgets:
            first = b.prefix << width if level <= LEVELS else b.prefix >> BITS * (level - LEVELS)
            second = 0 if level <= LEVELS else (b.prefix & ((1 << BITS * (level - LEVELS)) - 1)) << BITS * (2 * LEVELS - level)
            low.append((b.source, first, first + (1 << width), second, second + (1 << (BITS * (2 * LEVELS - max(level, LEVELS))))))
        bounds = spark.createDataFrame(low, "_source string, _a long, _b long, _c long, _d long")
        rows = rows.join(
            F.broadcast(bounds),
            rows["source"].eqNullSafe(F.col("_source")) & (F.col("k1") >= F.col("_a")) & (F.col("k1") < F.col("_b")) & (F.col("k2") >= F.col("_c")) & (F.col("k2") < F.col("_d")),
        )
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rest = spark.createDataFrame([(b.source, b.rest) for b in budgets], "_s string, _rest double")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    crossing = (
        sums.withColumn("upto", upto)
        .join(F.broadcast(rest), F.col("source").eqNullSafe(F.col("_s")))
        .where("upto > _rest")
        .groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "n")).alias("x"))
    )
    found = {r["source"]: r["x"] for r in crossing.collect()}
    for b in budgets:
        x = found.get(b.source)
        b.depth = level + 1
        if x is None:  # all of the bucket fits
            b.prefix, b.open = (b.prefix + 1) << BITS, False
            continue
        b.prefix = (b.prefix << BITS) + x["bucket"]
        b.rest -= x["upto"] - x["size"]
        if x["n"] == 1 or b.rest == 0 or level == 2 * LEVELS - 1:
            b.prefix += int(2 * b.rest >= x["size"])  # the nearer side
            b.open = False
