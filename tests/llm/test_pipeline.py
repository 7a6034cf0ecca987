"""Each stage against a brute-force version, with nulls, repeated rows, clashing names and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_jaccard import brute, corpus
from tiktoken.load import load_tiktoken_bpe

from phenoweave.llm import langid, mixing

CLASH = ("_place", "place", "text_", "_text", "_copy", "copy", "times", "_component", "component", "lang_pred", "score", "at", "norm", "hash", "root")
COLUMNS = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    """Documents ``(doc_id, text, lang, source)`` with a value of its own in every clashing column."""
    return spark.createDataFrame([(*r, *(f"{c}:{r[0]}" for c in CLASH)) for r in rows], COLUMNS)


def untouched(out, docs):
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = [tuple(r) for r in out.collect()]
    assert not Counter(set(rows)) - Counter({tuple(r) for r in docs.collect()})
    return rows


def real(spark, sf, n=120):
    got = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).select("doc_id", "text", "lang", "source").collect()
    return [tuple(r) for r in got]


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[:4]])
def test_empty_table_and_all_null(spark, sf, stage):
    docs = frame(spark, [(1, "a b c", "en", "s")])
    assert untouched(stage(spark, docs.limit(0), sf), docs) == []
    nothing = spark.createDataFrame([(None,) * (4 + len(CLASH))] * 3, COLUMNS)
    assert stage(spark, nothing, sf).columns == nothing.columns
    n = {cp.language_stage: 0, cp.exact_stage: 1}.get(stage, 3)
    assert len(stage(spark, nothing, sf).collect()) == n


def test_language_stage(spark, sf):
    rows = [*real(spark, sf), (900, None, "en", "s"), (901, "1 2 3 !!", "en", "s"), (902, "", None, "s"), (None, "zq xj qqq vvx jjj", None, None)]
    rows += rows[3:5]
    docs = frame(spark, rows)
    out = untouched(cp.language_stage(spark, docs, sf), docs)
    model = langid.fit(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False)))
    want = Counter()
    for d, t, *_ in rows:
        at, counts = langid.ngrams(t)
        want[d] += int(len(at) > 0 and model.probabilities(at, counts).max() >= cp.LEAST_LANGUAGE_SCORE)
    assert Counter(r[0] for r in out) == +want
    assert {900, 901, 902}.isdisjoint(r[0] for r in out) and len(out) > 100


def test_exact_stage(spark, sf):
    rows = [*real(spark, sf), (1000, "a b", None, None), (999, "ab ", None, None), (1001, None, "x", "y"), (1002, " ", "x", "y"), (None, "ab", None, None), (1003, "p", "x", "y"), (1003, "p", "x", "y")]
    docs = frame(spark, rows)
    out = untouched(cp.exact_stage(spark, docs, sf), docs)
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    assert Counter(r[0] for r in out) == Counter(min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for g in groups.values())


@pytest.mark.parametrize("seed", [5, 6])
def test_near_stage(spark, sf, seed):
    texts = [*corpus(seed, 250), (251, None), (252, ""), (253, "one"), (254, "ONE")]
    rows = [(d, t, "en", "s") for d, t in texts]
    rows += [rows[7], (None, rows[9][1], "en", "s")]
    docs = frame(spark, rows)
    out = untouched(cp.near_stage(spark, docs, sf), docs)
    place = [(i, r[1]) for i, r in enumerate(rows)]
    groups = defaultdict(list)
    for i, n, component in brute(place, 80, 100, 5):
        groups[component if n else ("alone", i)].append(rows[i][0])
    assert Counter(r[0] for r in out) == Counter(min(g, key=lambda d: (d is None, d or 0)) for g in groups.values())


def test_mixing_stage(spark, sf):
    rows = [*real(spark, sf), (900, None, "en", None), (901, "", "en", "s9"), (902, "word " * 50, "en", None)]
    rows += [rows[3]]
    docs = frame(spark, rows)
    out = untouched(cp.mixing_stage(spark, docs, sf), docs)
    assert sorted(map(str, out)) == sorted(map(str, cp.mixing_stage(spark, docs, sf).collect() and [tuple(r) for r in cp.mixing_stage(spark, docs, sf).collect()]))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times = Counter(r[0] for r in out)
    assert times[900] == times[901] == 1
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, t, _, s in rows:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    for r in out:
        taken[r[3]] += words(r[1])
    have = Counter(r[0] for r in rows)
    assert all(times[d] <= 2 * n for d, n in have.items())
    aims = mixing.targets(dict(sizes), mixing.cycle_weights(list(sizes)), 1.5, 2)
    assert all(abs(taken[s] - aims[s]) <= largest[s] for s in sizes)


def test_tokens_stage(spark, sf):
    rows = [*real(spark, sf, 40), (900, None, None, None), (901, "", None, None)]
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.tokens_stage(spark, frame(spark, rows), sf).collect()}
    for d, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_run_applies_the_stages(spark, tmp_path):
    rows = [r for r in real(spark, "/root/testdata/sf0.001", 150)]
    rows += [(2000 + i, r[1], r[2], r[3]) for i, r in enumerate(rows[:20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    step = docs
    for _, stage in cp.STAGES:
        step = stage(spark, step, str(tmp_path))
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in step.collect())
    assert {r.doc_id for r in out} and not {r.doc_id for r in out} & set(range(2000, 2020))
