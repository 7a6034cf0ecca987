from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phenoweave.llm import mixing


def brute(rows, seed=17):
    """``rows (doc_id, source, size, hash)``: sorted by hash, each source takes what is nearest to its budget."""
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    aims = mixing.targets(dict(sizes), mixing.cycle_weights(list(sizes)), 1.5, 2)
    out = {}
    for s, total in sizes.items():
        repeats = min(int(aims[s] // total), 2) if total else 0
        rest, open_ = aims[s] - repeats * total, total > 0
        for d, _, n, _ in sorted((r for r in rows if r[1] == s), key=lambda r: r[3]):
            extra = 0
            if open_ and rest > 0:
                if n <= rest:
                    extra, rest = 1, rest - n
                else:
                    extra, open_ = int(2 * rest >= n), False
            out[d] = (repeats + extra) * n
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 17 != 0, F.col("source")))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text"), 64 - mixing.BITS * mixing.LEVELS)
    rows = [tuple(r) for r in docs.select("doc_id", "source", mixing.word_count().alias("n"), key.alias("k")).collect()]
    assert len({r[3] for r in rows}) == len(rows)
    want = brute([r for r in rows if r[2]])
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert {d: t for d, t in got.items() if d in want} == want
    assert all(t == 0 for d, t in got.items() if d not in want)
