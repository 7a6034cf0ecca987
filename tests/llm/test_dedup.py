import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phenoweave.llm import dedup, store

ROWS = [(1, "a b"), (2, "ab "), (3, "a\tb\x0b\x0c\r\n"), (4, None), (5, ""), (6, "  "), (7, "ab c"), (None, "a  b    "), (9, "A b"), (10, "a b"), (11, "a b"), (11, "a b"), (12, "same row"), (12, "same row"), (13, "x" * 300_000), (14, "x" * 300_000 + " ")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda x: x[0:3])
        first = True
        for x in sorted(g, key=lambda x: x[:3]):
            out.append((x[3], keep[3], len(g), first, hashlib.sha256(norm.encode()).hexdigest()))
            first = False
    return Counter(out)


@pytest.mark.parametrize("capacity", [4096, 2])
def test_same_as_brute_force(spark, capacity):
    r = random.Random(1)
    rows = ROWS + [(100 + i, " ".join(r.choice("abc") for _ in range(r.randrange(6)))) for i in range(500)]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, hash string")
    out = dedup.exact_dedup(docs, capacity).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in out) == brute(rows)
    kept = dedup.drop_copies(docs, capacity)
    assert kept.columns == docs.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(k[0] for k, n in brute(rows).items() for _ in range(n) if k[3])
    assert dedup.exact_dedup(docs.limit(0)).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    slots = spark.range(4000).selectExpr("CASE WHEN id < 3000 THEN id * 8 ELSE id * 8 + 1 END AS hash")
    table, depth = dedup.directory(slots, 500)
    cells = [tuple(x) for x in table.collect()]
    used = {h & ((1 << depth) - 1) for (h,) in slots.collect()}
    assert sorted(c for c, _, _ in cells) == sorted(used)
    assert all(c & ((1 << local) - 1) == b for c, b, local in cells)
    assert len({local for _, _, local in cells}) > 1
    of = {c: (b, local) for c, b, local in cells}
    sizes = Counter(of[h & ((1 << depth) - 1)] for (h,) in slots.collect())
    assert max(sizes.values()) <= 500
    halves = Counter()
    for (b, local), n in sizes.items():
        halves[(b & ((1 << (local - 1)) - 1) if local else 0, local - 1)] += n
    whole = lambda b, d: sum(h & ((1 << d) - 1) == b for (h,) in slots.collect())
    assert all(whole(b, d) > 500 for b, d in halves if d >= 0)
    assert {x[1:] for x in dedup.directory(slots.limit(3), 500)[0].collect()} == {(0, 0)}
    table, depth = dedup.directory(spark.createDataFrame([(5,)] * 40, "hash long"), 4)  # one hash can't be split
    assert depth == dedup.BITS and [tuple(x) for x in table.collect()] == [(5, 5, dedup.BITS)]


def test_collisions_are_chained(spark):
    few = lambda c: F.xxhash64(c).bitwiseAND(F.lit(3))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = dedup.exact_dedup(docs, 2, few).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in out) == brute(ROWS)
    norm = docs.select(few(dedup.normalised()).alias("hash"), dedup.normalised().alias("norm"), F.col("doc_id").alias("rank"))
    index = dedup.build_index(norm, 2)[0].collect()
    chains = defaultdict(list)
    for x in index:
        chains[(x["bucket"], x["hash"])].append(x["chain"])
    assert max(map(len, chains.values())) > 1 and all(sorted(c) == list(range(len(c))) for c in chains.values())


def test_the_index_decides(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "p"), (2, "p")], "doc_id long, text string")
    build = dedup.build_index
    monkeypatch.setattr(dedup, "build_index", lambda *a: (build(*a)[0].limit(0), *build(*a)[1:]))
    assert [x.group_size for x in dedup.exact_dedup(docs).collect()] == [1, 1]


def test_hot_groups_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(store, "LEAST_HOT", 3)
    rows = ROWS + [(1000 + i, "hot text") for i in range(40)]
    out = dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in out) == brute(rows)


def test_string_ids_and_names_that_clash(spark):
    rows = [("P2", "a b", 1, 2, 3), ("P1", "ab ", 4, 5, 6), (None, "ab", 7, 8, 9), ("P3", "c", 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, place int, _place int, norm int")
    out = {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in dedup.exact_dedup(docs).collect()}
    assert out == {("P1", "P1", 3, True), ("P2", "P1", 3, False), (None, "P1", 3, False), ("P3", "P3", 1, True)}
    assert sorted(tuple(x) for x in dedup.drop_copies(docs).collect()) == sorted(r for r in rows if r[0] in ("P1", "P3"))
