"""The verdict of the distribution rules against a version in plain Python."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from phenoweave.llm import rules


def histogram(text):
    out = [0] * (len(rules.CLASSES) + 1)
    kinds = {"Ll": 0, "Lu": 1, "Nd": 2}
    for c in text:
        k = kinds.get(unicodedata.category(c))
        if k is None:
            k = 3 if c in ".,;:?'\"()-" else 4 if c == "!" else 5 if c in "#*$%&|<>" else 6
        out[k] += 1
    return out


def shares(counts):
    n = max(sum(counts), 1)
    return [c / n for c in counts]


def distance(p, q):
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q, strict=True)) / 2))


def brute(rows, common=rules.COMMON_WORDS, max_classes=0.28, max_words=0.4):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tally, langs = defaultdict(Counter), {lang for _, t, lang in rows if lang is not None and words(t)}
    for _, t, lang in rows:
        for w in words((t or "").lower()):
            tally["*"][w] += 1
            if lang is not None:
                tally[lang][w] += 1
    top = {k: sorted(c, key=lambda w: (-c[w], w))[:common] for k, c in tally.items()}
    of = lambda lang: lang if lang in langs else "*"
    sums = defaultdict(lambda: [0] * 7)
    for _, t, lang in rows:
        h = histogram("".join(words(t)))
        for k in (of(lang), "*"):
            if k != "*" or of(lang) != "*":
                sums[k] = [a + b for a, b in zip(sums[k], h, strict=True)]
        if of(lang) == "*":
            sums["*"] = [a + b for a, b in zip(sums["*"], h, strict=True)]
    out = {}
    for d, t, lang in rows:
        w, ref = words(t), of(lang)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        js_c = distance(shares(histogram("".join(w))), shares(sums[ref])) if w else None
        counts, total = Counter(x.lower() for x in w), sum(tally[ref].values())
        mine = [counts[x] / max(len(w), 1) for x in top.get(ref, [])]
        theirs = [tally[ref][x] / total for x in top.get(ref, [])]
        js_w = distance([*mine, max(0.0, 1 - sum(mine))], [*theirs, max(0.0, 1 - sum(theirs))])
        odd = (sum(map(len, w)) >= 200 and js_c > max_classes) or (len(w) >= 50 and js_w > max_words)
        out[d] = (len(again), failed, not failed and not odd, js_c, js_w)
    return out


@pytest.mark.parametrize("common", [rules.COMMON_WORDS, 5])
def test_verdict(spark, sf, common):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [
        (9001, "123 456 !!! ### " * 60, "en"), (9002, " ".join(f"word{i}x" for i in range(80)), "en"), (9003, "ÀÉ " * 90 + "the of and", None),
        (9004, None, "en"), (9005, "", None), (9006, "odd tongue " * 3 + " ".join(f"q{i}" for i in range(60)), "xx"), (9007, "a b c " * 40, "de"),
    ]
    want = brute(rows, common)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, _w string")
    got = {r.doc_id: r for r in rules.quality_rules(docs, common_words=common).collect()}
    assert got.keys() == want.keys()
    for d, (again, failed, kept, js_c, js_w) in want.items():
        r = got[d]
        assert (r.n_repeat_words, r.base_failed, r.kept) == (again, failed, kept), d
        assert r.js_words == pytest.approx(js_w, abs=1e-6)
        if js_c is not None:
            assert r.js_classes == pytest.approx(js_c, abs=1e-6)
    assert {r.kept for r in got.values()} == {True, False}
    assert any(not r.kept and not r.base_failed for r in got.values())


def test_thresholds_on_rows_they_were_not_chosen_on(spark):
    """Limits were chosen on doc_ids of sf0.01; sf0.1 has ten times as many documents."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct()
    out = rules.quality_rules(docs).where("not base_failed").select("doc_id", "kept")
    fresh = docs.select("doc_id", "text").join(seen, "text", "left_anti").select("doc_id")
    rows = out.join(fresh, "doc_id").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    good = n.get((1, True), 0) / max(1, n.get((1, True), 0) + n.get((1, False), 0))
    assert good >= 0.98, n
