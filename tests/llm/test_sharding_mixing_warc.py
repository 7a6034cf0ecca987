import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from phenoweave.llm import mixing, sharding, warc


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 40, 41, 1000, 4096, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, seed=3, back=True).tolist() == list(range(n))
    if n > 100:
        assert not np.array_equal(p, sharding.permute(np.arange(n), n, seed=4))


def test_shards(spark):
    rows = [(i, f"text {i % 5}" if i % 7 else None, i, "x") for i in range(503)] + [(None, "a", 1, "y"), (None, None, 1, "y"), (3, "same", 0, "z"), (3, "same", 0, "z"), (4, "é" * 100_000, 0, "z"), (5, "", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")
    out = sharding.shard(docs, 40).collect()
    assert len(out) == len(rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    have = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == have
    assert all(sharding.inverse(r.shard, r.slot, 40, len(out)) == r.row_no for r in out[:50])
    again = sharding.shard(docs.repartition(7), 40).collect()
    key = lambda rs: Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(out) == key(again)
    assert sharding.shard(docs.limit(0), 40).count() == 0


def test_targets():
    t = mixing.targets({"a": 100, "b": 1000, "c": 10}, {"a": 5, "b": 2, "c": 1}, 1.5, 2)
    assert t["a"] == 200 and t["c"] == 20 and abs(sum(t.values()) - 1665) < 1e-9
    assert mixing.cycle_weights(["b", None, "a", "c"]) == {"a": 5, "b": 2, "c": 1, None: 5}
    assert mixing.targets({"a": 0}, {"a": 5}, 1.5, 2) == {"a": 0.0}


def test_mix(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 3}" if i % 4 else None) for i in range(3000)]
    rows += [(None, None, "s1"), (7, "one two\x0bthree x", "s2"), (1, "x " * 200_000, "s0")] + [(9, "copy of one row", "s2")] * 1500
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert sorted(r["size"] for r in by["s2"])[-1] == 49
    for s, rs in by.items():
        total = sum(r["size"] for r in rs)
        assert {r.source_size for r in rs} == {total}
        largest = max(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= largest
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * sum(r["size"] for r in out)) < 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in out) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_record():
    data = warc.build_record(5, "http://a/ü b\r\nX: y", b"<p>\r\n\r\n</p>")
    headers, payload = warc.parse_record(data)
    assert payload == b"<p>\r\n\r\n</p>" and "x" not in headers and headers["warc-target-uri"] == "http://a/%C3%BC%20b%0D%0AX:%20y"
    for bad in (data[:-1], b"x" + data, data + b"\r\n"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_archive(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "n", big), (8, "é", "é" * 500), (9, "é", "é" * 500), (10, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    out = warc.archive(pages).collect()
    kind = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in out)
    assert kind == Counter({(1, "revisit", 3, 2003): 1, (2, "revisit", 3, 2003): 1, (3, "response", None, 2003): 2, (4, "response", None, 0): 1, (5, "response", None, 0): 1, (6, "response", None, 5): 1, (7, "response", None, 5): 1, (None, "revisit", 3, 2003): 1, (8, "revisit", 9, 1000): 1, (9, "response", None, 1000): 1, (10, "response", None, 3_000_000): 1})
    assert warc.archive(pages.limit(0)).count() == 0
    folder = warc.new_path(spark, "warc")
    index = warc.write(warc.mark_revisits(pages), folder, new_file_bytes=100)
    assert index.select("file").distinct().count() > 1
    back = warc.read(index.where("page_id in (6, 8, 10)"), folder, payloads=True).collect()
    assert {(r.page_id, len(r.payload)) for r in back} == {(6, 5), (8, 0), (10, 3_000_000)}
