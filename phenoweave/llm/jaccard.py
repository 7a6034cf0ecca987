"""Exact Jaccard join on word n-grams over trees of count vectors.

A document is the set of its distinct hashed n-grams.  Hashing the n-grams into
groups turns it into a point, the vector of group counts; the sum of coordinate
minima of two points bounds their overlap from above.

* Upper levels, over the cluster.  Boxes of count vectors don't separate sets of
  more than some hundred n-grams (README has figures), so the upper levels split
  by shared n-grams instead.  Sets that link share so many n-grams that a set can
  be left out as soon as too few of its n-grams occur in any other set; first in
  a window of the least hashes, then in whole sets.  What is left enters a node
  for each n-gram of a short prefix, rarest first; linked sets meet in a node.
  Connected nodes are one branch.
* Lower levels, inside a branch: an R-tree of packed boxes over count vectors,
  searched by summed minima.  Survivors are verified on the spot on whole sets,
  and a union of what is already linked leaves only pairs that can still matter.

A branch ships each set once, in cells of bounded size, and gives back fewer links
than it has members.  No candidate is ever dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialize, remove, small_batches

GROUPS = 256  # coordinates of the count vectors
CELL = 1024  # members that one task compares with as many others
CELL_ITEMS = 4_000_000  # n-grams that one task holds of either side, but for a single longer set
BATCH = 512  # sets in one Arrow batch
FANOUT = 16
WORDS_KEPT = 200_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, A-Z in lower case.

    Words are runs of anything but ASCII white space.  Fewer words than
    ``width`` are one n-gram; none give an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        k = min(width, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            total = mix(total * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        x, y = np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D))), np.add.reduce(mix(s + U(0x14057B7EF767814F)))
    return tuple(np.array([x, y], dtype=np.uint64).view(np.int64).tolist())


def differ(n: int, num: int, den: int) -> int:
    """Most n-grams that are in just one of a set of ``n`` and a set linked with it."""
    return n * (den - num) // num


def window(n: int, num: int, den: int) -> int:
    """How many of the least hashes the first step looks at; 0: only equal sets link.

    Of the windows of linked sets, the one that ends first lies in the other but
    for the n-grams that differ, so twice as many leave enough in common.
    """
    d = differ(n, num, den)
    return min(n, 2 * d + 2) if d else 0


def shared_in_window(n: int, num: int, den: int) -> int:
    """Least overlap of the windows of a set of ``n`` and any set linked with it."""
    least = -(-n * num // den)
    return max(1, window(least, num, den) - differ(n, num, den)) if differ(least, num, den) else 1


class CountTree:
    """R-tree of count vectors, packed by sorting on the coordinates in turn."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._pack(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: largest counts, least size of each branch
        top, least = self.points, self.sizes
        while len(top) > FANOUT:
            cuts = np.arange(0, len(top), FANOUT)
            top, least = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least))

    @staticmethod
    def _pack(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        spread = np.argsort(-(points.max(0) - points.min(0)), kind="stable")[:3] if len(points) else []
        return np.lexsort([*(points[:, i] for i in spread[::-1]), sizes])

    def search(self, q: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Positions of the points whose overlap bound allows the threshold."""
        def can(tops, least):
            return np.minimum(tops, q).sum(1) * (den + num) >= num * (least + n)

        hits = None
        for level in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[level]
            hits = np.flatnonzero(can(tops, least)) if hits is None else hits[can(tops[hits], least[hits])]
            hits = (hits[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            hits = hits[hits < (len(self.levels[level - 1][0]) if level else len(self.points))]
        if hits is None:
            hits = np.arange(len(self.points))
        return self.order[hits[can(self.points[hits], self.sizes[hits])]]


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([np.bincount((s & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets], dtype=np.int32).reshape(len(sets), GROUPS)


def linked_pairs(sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray, told: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Positions of verified pairs that join what links between members in ``asks`` and in ``told`` join.

    ``labels`` (changed here) says what is linked already; pairs with one label are skipped.
    """
    points, sizes = count_vectors(sets), np.array([len(s) for s in sets], dtype=np.int64)
    tree, out, done = CountTree(points, sizes), [], np.zeros(len(sets), dtype=bool)
    for q in np.flatnonzero(asks):
        done[q] = told[q]  # it was compared with all of them
        hits = tree.search(points[q], int(sizes[q]), num, den)
        hits = hits[(labels[hits] != labels[q]) & told[hits] & ~done[hits]]
        while len(hits):
            c, hits = hits[0], hits[1:]
            common = len(np.intersect1d(sets[q], sets[c], assume_unique=True))
            if common * (den + num) >= (len(sets[q]) + len(sets[c])) * num:
                out.append((int(q), int(c)))
                labels[labels == labels[c]] = labels[q]
                hits = hits[labels[hits] != labels[q]]
    return out


def jaccard_join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Components of documents linked by ``den * intersection >= num * union``.

    Columns doc_id, n_shingles, component_id, n_copies (rows with the same set);
    one row for each row of ``docs``.  component_id is the least doc_id that
    links reach.  Null texts and texts without words have an empty set and link
    with nothing (component_id is their doc_id).  A null doc_id is never the
    least unless all of a component are null; rows may repeat.  Other columns are
    not read; an empty table gives no rows.

    n-grams are compared by 64-bit hashes, whole sets by two more of them.
    """
    spark = docs.sparkSession
    rows = materialize(_points(docs, width, num, den), "jaccard-rows")
    names = materialize(rows.select("doc_id", "n", "f", "f2"), "jaccard-names")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "k")).alias("first")
    sets = rows.where("n > 0").groupBy("f", "f2").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("win").alias("win"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("s"), "*"), "jaccard-sets")
    remove(rows, spark)

    entries = sets.select("s", F.explode("win").alias("h"))
    shared = _kept(entries, sets, F.expr(f"greatest(1, {_window_sql(f'({_least_sql("n", num, den)})', num, den)} - {_differ_sql('n', num, den)})"))
    windows, sets = sets, materialize(sets.drop("win"), "jaccard-names")
    remove(windows, spark)
    whole = _whole(docs, shared.join(sets.select("s", "first"), "s"), width)
    remove(shared, spark)
    roots = components(_meeting(whole, num, den), "jaccard-branches")
    cells = materialize(whole.join(roots, whole["s"] == roots["node"]).select("root", "s", "n", "items"), "jaccard-cells")
    remove(whole, spark)
    remove(roots, spark)
    links = _first_links(cells, num, den)
    sizes = cells.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("load")).where(_parts("size", "load") > 1)
    if sizes.limit(1).count():
        links = materialize(links.unionByName(_other_links(cells, sizes, links, num, den)), "jaccard-links")
    roots = components(links, "jaccard-components")
    remove(cells, spark)
    remove(links, spark)

    rooted = sets.join(roots, sets["s"] == roots["node"], "left").withColumn("root", F.coalesce("root", "s"))
    least = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"), F.sum("copies").alias("c"))
    grouped = rooted.join(least.where("c > 1"), "root").select("f", "f2", "component_id", "copies")
    return names.join(grouped, ["f", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, dtype=np.int64)))


def _points(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``doc_id, k (hash of the text), n, f, f2 (fingerprints), win (least hashes)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f, g, least = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), width)
                a, b = fingerprint(s) if len(s) else (None, None)
                n.append(len(s))
                f.append(a)
                g.append(b)
                least.append(s[: window(len(s), num, den)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), _lists(least)], names=["doc_id", "k", "n", "f", "f2", "win"])

    return small_batches(docs).select("doc_id", F.xxhash64("text").alias("k"), "text").mapInArrow(run, f"doc_id {kind}, k long, n long, f long, f2 long, win array<long>")


def _common(entries: DataFrame) -> DataFrame:
    """``h, times`` of the n-grams of ``entries (s, h)`` that more than one set has."""
    return entries.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")


def _differ_sql(n: str, num: int, den: int) -> str:
    return f"({n} * {den - num} div {num})"


def _window_sql(n: str, num: int, den: int) -> str:
    d = _differ_sql(n, num, den)
    return f"(CASE WHEN {d} > 0 THEN least({n}, 2 * {d} + 2) ELSE 0 END)"


def _least_sql(n: str, num: int, den: int) -> str:
    """The least set that a set of ``n`` may link with, and the least overlap with any."""
    return f"({n} * {num} + {den - 1}) div {den}"


def _kept(entries: DataFrame, sets: DataFrame, least: Column) -> DataFrame:
    """``s`` of the sets that share at least ``least`` of their entries with any other set."""
    common = materialize(_common(entries), "jaccard-common")
    counts = entries.join(common, "h").groupBy("s").agg(F.count("*").alias("had"))
    kept = materialize(counts.join(sets.select("s", "n"), "s").where(F.col("had") >= least).select("s"), "jaccard-kept")
    remove(common, entries.sparkSession)
    return kept


def _whole(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``s, n, items`` of the wanted sets, from the texts that ``first`` names."""
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_k"), F.col("text").alias("_text"))
    named = wanted.select("s", F.col("first.doc_id").alias("_d"), F.col("first.k").alias("_h"))
    texts = keyed.join(named, keyed["_id"].eqNullSafe(named["_d"]) & (keyed["_k"] == named["_h"])).select("s", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in items], pa.int64()), _lists(items)], names=["s", "n", "items"])

    return materialize(texts.mapInArrow(run, "s long, n long, items array<long>").dropDuplicates(["s"]), "jaccard-whole")


def _meeting(whole: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: each set and the least one of every node that it enters with others.

    Only n-grams that other sets have count.  A set that lacks enough of them has no
    link.  In the common order (rarest first, then by hash) the first n-gram that two
    linked sets share is among the first ``had - least + 1`` of both.
    """
    spark = whole.sparkSession
    entries = whole.select("s", "n", F.explode("items").alias("h"))
    common = materialize(_common(entries), "jaccard-common")
    listed = entries.join(common, "h").groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct("times", "h"))).alias("hs"))
    short = F.expr(f"size(hs) - {_least_sql('n', num, den)} + 1").cast("int")
    keys = listed.withColumn("short", short).where("short > 0").select("s", F.explode(F.slice("hs", F.lit(1), F.col("short"))).alias("x")).select("s", "x.h")
    keys = materialize(keys, "jaccard-keys")
    nodes = keys.groupBy("h").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo < hi")
    edges = materialize(keys.join(nodes, "h").where("s <> lo").select(F.col("s").alias("a"), F.col("lo").alias("b")).distinct(), "jaccard-edges")
    remove(common, spark)
    remove(keys, spark)
    return edges


def _parts(size: str, load: str) -> Column:
    """How many cells a branch is cut into."""
    return F.greatest(F.ceil(F.col(size) / CELL), F.ceil(F.col(load) / CELL_ITEMS)).cast("int")


def _place(parts: str) -> Column:
    return F.pmod(F.xxhash64("s", F.lit(3)), F.col(parts)).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _first_links(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning links ``a, b`` inside each cell; a branch's least member is in all its cells."""
    sizes = cells.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("load")).select("root", _parts("size", "load").alias("parts"))
    dealt = cells.join(sizes, "root").withColumn("t", F.when(F.col("s") == F.col("root"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_place("parts"))))
    dealt = dealt.select("root", F.lit(0).alias("q"), F.explode("t").alias("t"), F.lit(0).alias("side"), "s", F.col("s").alias("label"), "items")
    return _searched(dealt, num, den, both=True)


def _other_links(cells: DataFrame, sizes: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links between what the cells of a branch have left apart.

    The members of the commonest component are searched by all others, and these
    search each other.  Both sides are dealt into cells.
    """
    spark = cells.sparkSession
    roots = components(links, "jaccard-components")
    large = cells.join(sizes.select("root", _parts("size", "load").alias("nt")), "root")
    labelled = large.join(roots.select(F.col("node").alias("s"), F.col("root").alias("label")), "s", "left").withColumn("label", F.coalesce("label", "s"))
    light = labelled.select("root", "label", "n", "nt")
    per_label = light.groupBy("root", "label").agg(F.count("*").alias("c"), F.sum("n").alias("l"))
    apart = per_label.groupBy("root").agg(F.max(F.struct("c", "label", "l")).alias("x"), F.sum("c").alias("c"), F.sum("l").alias("l"))
    apart = apart.select("root", F.col("x.label").alias("common"), (F.col("c") - F.col("x.c")).alias("others"), (F.col("l") - F.col("x.l")).alias("weight")).where("others > 0")
    base = labelled.join(apart.select("root", "common", _parts("others", "weight").alias("nq")), "root")
    asks = base.where("label <> common").withColumns({"q": _place("nq"), "side": F.lit(0)}).withColumn("t", _every("nt"))
    told = base.withColumns({"t": _place("nt"), "side": F.lit(1)}).withColumn("q", _every("nq"))
    columns = ["root", "q", "t", "side", "s", "label", "items"]
    found = _searched(asks.select(columns).unionByName(told.select(columns)), num, den, both=False)
    remove(roots, spark)
    return found


def _searched(dealt: DataFrame, num: int, den: int, both: bool) -> DataFrame:
    """Verified links ``a, b`` of all cells ``root, q, t``; with ``both`` any members are compared, else side 0 with side 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            items = batch.column(6)
            flat, at = items.values.to_numpy().view(np.uint64), items.offsets.to_numpy()
            a, b = [], []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)):
                if held and held[-1][0][:3] != row[:3]:
                    _cell(held, a, b, num, den, both)
                    held = []
                held.append((row, flat[at[i] : at[i + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = [], []
        _cell(held, a, b, num, den, both)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cells = dealt.repartition("root", "q", "t").sortWithinPartitions("root", "q", "t", "side")
    return materialize(cells.mapInArrow(run, "a long, b long"), "jaccard-links", BATCH)


def _cell(held: list[tuple], a: list, b: list, num: int, den: int, both: bool) -> None:
    if len(held) < 2:
        return
    sets = [s for _, s in held]
    labels = np.array([row[5] for row, _ in held])
    asks = np.array([row[3] == 0 for row, _ in held])
    for x, y in linked_pairs(sets, labels, asks, asks if both else ~asks, num, den):
        a.append(held[x][0][4])
        b.append(held[y][0][4])
