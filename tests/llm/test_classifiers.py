import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoweave.llm import langid, quality, rules

EDGE = [(900_001, None, "en"), (900_002, "", "en"), (900_003, "123 !!", "de"), (None, "the of and the", None), (900_004, "ein und der die das " * 40_000, "de"), (900_005, "x", None), (900_005, "x", None)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame(EDGE, "doc_id long, text string, lang string")
    return base.unionByName(more).withColumns({"score": F.lit("x"), "x": F.lit(1), "lang_pred": F.lit(0)})


def mod(n):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def test_language_accuracy_and_edges(spark, docs):
    model = langid.fit(docs, mod(4) != 2)
    assert (model.weights == 0).mean() > 0.5
    out = langid.predict(docs, model, ["doc_id", "lang"]).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900_000]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900_001, 900_002, 900_003))
    assert by[900_004].lang_pred == "de" and all(0 <= r.score <= 1 for r in out)
    empty = langid.fit(docs.limit(0), mod(4) != 2)
    assert {r.lang_pred for r in langid.predict(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_document_frequencies_cover_all_rows(spark, docs):
    rows = docs.where("doc_id < 300")
    df, n = langid.document_frequencies(rows.repartition(7), fan_in=2)
    want = np.zeros(langid.DIM, dtype=int)
    texts = [r.text for r in rows.collect()]
    for t in texts:
        want[langid.ngrams(t)[0]] += 1
    assert n == len(texts) and (df == want).all()


def test_quality_held_out(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(5, None), (5, 7), (None, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(None).cast("int"))
    out = quality.score(docs, labels.unionByName(odd), mod(5) != 0).join(labels, "doc_id", "left").withColumn("held", mod(5) == 0).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held and r.quality is not None]
    assert len(held) > 50 and np.mean([(r.score >= 0.3) == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    none = quality.score(docs.where("doc_id < 9 or doc_id is null"), labels.limit(0), mod(5) != 0).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(docs.limit(0), labels, mod(5) != 0).count() == 0


def test_discriminant_is_the_density_ratio():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (500, 3)), r.normal(1, 2, (700, 3))])
    y = np.repeat([0.0, 1.0], [500, 700])
    m = quality.fit(x, y, 0, 0)
    for k in (0, 1):
        s = np.cov(x[y == k].T, bias=True) + 1e-6 * np.eye(3)
        d = x - x[y == k].mean(0)
        dens = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1]
        diff = dens if k == 0 else dens - diff
    assert np.allclose(m.difference(x), diff)


def test_rules_edges(spark, docs):
    import re
    from collections import Counter

    out = rules.quality_rules(docs).collect()
    assert len(out) == docs.count()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        t = texts[r.doc_id] or ""
        w = word.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if c[g] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_js_distance(spark):
    got = spark.createDataFrame([([0.5, 0.5, 0.0], [0.5, 0.5, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.2, 0.3, 0.5], [0.4, 0.4, 0.2])], "p array<double>, q array<double>").select("p", "q", rules.js_distance("p", "q").alias("d")).collect()
    for r in got:
        p, q = np.array(r.p), np.array(r.q)
        m = (p + q) / 2
        kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)  # noqa: B023, E731
        assert abs(r.d - np.sqrt(max(0, kl(p) / 2 + kl(q) / 2))) < 1e-12
