import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoweave.functions import identifiers, text
from phenoweave.operators import answers, autoencoder, comparison, dense, explain, extraction, graph, ontology, registry, semantic

EDGES = [("A", "R"), ("B", "A"), ("C", "A"), ("D", "R")]
PROFILES = [(1, "B"), (1, "C"), (2, "D"), (3, "C")]


@pytest.fixture(scope="module")
def small(spark):
    edge = spark.createDataFrame(EDGES, "child string, parent string")
    profile_term = spark.createDataFrame(PROFILES, "disease_id long, term string")
    profile = spark.createDataFrame([(1,), (2,), (3,), (4,)], "disease_id long")
    label = spark.createDataFrame([("B", "big hands"), ("C", "cold feet"), ("D", "deep voice")], "term string, label string")
    texts = spark.createDataFrame([(1, "big big hands"), (2, "deep voice at night"), (3, "cold feet")], "disease_id long, text string")
    return registry.Context(profile, profile_term, edge, label, texts, profile_term.limit(0), spark.createDataFrame([], "patient_id long, term string"))


def test_bma_blocks_and_joins_agree(spark, monkeypatch):
    r = np.random.default_rng(0)
    edge = spark.createDataFrame([(int(i), int(i // 3)) for i in range(1, 60)] + [(int(i), int(i // 5)) for i in range(20, 60, 4)], "child long, parent long")
    up = ontology.closure(edge, inclusive=True)
    ic = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(np.round(r.random(60) * 4, 3)) if i % 7], "term long, ic double").withColumn("ic", F.when(F.col("term") % 11 == 0, 0.0).otherwise(F.col("ic")))
    some = lambda n, key: spark.createDataFrame([(int(i), int(t)) for i in range(n) for t in set(r.integers(0, 60, 5))], f"{key} long, term long")
    p, d = some(20, "patient_id"), some(30, "disease_id")
    monkeypatch.setattr(semantic, "PATIENT_BLOCK", 7)
    monkeypatch.setattr(semantic, "PROFILE_BLOCK", 11)
    for m in semantic.MEASURES:
        one = {tuple(x) for x in semantic.rank(p, d, up, ic, m).collect()}
        with monkeypatch.context() as mp:
            mp.setattr(semantic, "MOST_PATHS", 0)
            two = {tuple(x) for x in semantic.rank(p, d, up, ic, m).where("score > 0").collect()}
        assert {x for x in one if x[3] > 0} == two and len(one) == 200


def test_mica_and_distance(spark):
    up = ontology.closure(spark.createDataFrame(EDGES, "child string, parent string"), inclusive=True)
    ic = spark.createDataFrame([("R", 0.0), ("A", 1.0), ("B", 3.0), ("C", 2.5)], "term string, ic double")
    m = semantic.mica(spark.createDataFrame([("B", "C"), ("B", "D"), ("C", "C")], "a string, b string"), up, ic)
    assert {tuple(x) for x in m.collect()} == {("B", "C", "A", 1.0), ("B", "D", "R", 0.0), ("C", "C", "C", 2.5)}
    assert {(x.a, x.b, x.distance) for x in semantic.mica_distance(m, ic).collect()} == {("B", "C", 3.5), ("B", "D", 3.0), ("C", "C", 0.0)}


def test_transitions_and_walks(spark, small):
    edges, weight = graph.build(small.edge, small.profile_term), graph.weights(small.ic)
    steps = graph.transitions(edges, weight, 2.0, 0.5)
    sums = steps.groupBy("previous", "current").agg(F.sum("probability").alias("s")).collect()
    assert all(abs(x.s - 1) < 1e-9 for x in sums)
    real = {(x.src, x.dst) for x in edges.collect()}
    found = graph.walks(edges, weight, length=12, per_node=3).collect()
    assert len(found) == 3 * len({a for a, _ in real})
    assert all(x.path[0] == x.node and len(x.path) == 12 and set(zip(x.path, x.path[1:], strict=False)) <= real for x in found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, graph.walks(edges, weight, length=12, per_node=3).collect()))
    starts = edges.select(F.col("src").alias("node")).distinct().withColumn("walk", F.lit(1))
    joined = graph.walks_by_joins(edges, weight, starts, 5, 1.0, 0.5, 0).collect()
    assert all(len(x.path) == 5 and set(zip(x.path, x.path[1:], strict=False)) <= real for x in joined)


def test_walks_follow_the_probabilities(spark):
    edges = spark.createDataFrame([("t:a", "t:b"), ("t:b", "t:a"), ("t:b", "t:c"), ("t:c", "t:b"), ("t:b", "t:d"), ("t:d", "t:b")], "src string, dst string")
    weight = spark.createDataFrame([("t:a", 1.0), ("t:c", 3.0), ("t:d", 0.0)], "node string, weight double")
    want = {x.next: x.probability for x in graph.transitions(edges, weight, 4.0, 0.5).where("previous = 't:a' and current = 't:b'").collect()}
    assert want == pytest.approx({"t:a": 0.25 / 6.25, "t:c": 6 / 6.25, "t:d": 0.0})
    for paths in (graph.walks(edges, weight, 3, 4000, 4.0, 0.5), graph.walks_by_joins(edges, weight, spark.createDataFrame([("t:a", i) for i in range(4000)], "node string, walk int"), 3, 4.0, 0.5, 1)):
        third = [x.path[2] for x in paths.where("node = 't:a'").collect()]
        assert abs(third.count("t:c") / 4000 - want["t:c"]) < 0.02 and "t:d" not in third


def test_embeddings_rank_the_same_set_first(spark, small):
    weight = graph.weights(small.ic)
    vectors = graph.embed(graph.walks(graph.build(small.edge, small.profile_term), weight, 20, 5), dim=8, window=3, epochs=1)
    asked = spark.createDataFrame([(7, "D"), (8, "unknown")], "patient_id long, term string")
    out = graph.rank(asked, small.profile_term, vectors, weight).collect()
    assert [(x.patient_id, x.disease_id) for x in out if x["rank"] == 1] == [(7, 2)] and len(out) == 3


def test_autoencoder(spark, small, tmp_path):
    rng = np.random.default_rng(0)
    x = np.array([1, 1, 1, 1, 1, 0, 0, 0, 0, 0] * 4, dtype=np.float32)
    y = autoencoder.corrupt(x, rng, 0.2, 0.1)
    assert (y[x == 1] == 0).sum() == 4 and (y[x == 0] == 1).sum() == 2
    rows = (rng.random((80, 30)) < 0.2).astype(np.float32)
    model = autoencoder.Autoencoder.new(30, 16, 8).train(rows, epochs=30, rate=0.5)
    assert model.losses[-1] < model.losses[0]
    values = model.forward(rows[:3])
    loss, slopes = model.gradients(rows[:3], values)
    assert [s[0].shape for s in slopes] == [w.shape for w in model.weights] and loss > 0
    model.save(str(tmp_path / "m.npz"))
    assert np.allclose(autoencoder.Autoencoder.load(str(tmp_path / "m.npz")).encode(rows), model.encode(rows))
    model, terms = autoencoder.fit(small.profile_term, epochs=3, hidden=8, latent=4)
    assert terms == ["B", "C", "D"] and autoencoder.cache_key(terms, epochs=3) != autoencoder.cache_key(terms, epochs=4)
    asked = spark.createDataFrame([(5, "D"), (6, "nothing")], "patient_id long, term string")
    out = autoencoder.rank(asked, small.profile_term, model, terms).collect()
    assert {(x.disease_id, x.score) for x in out if x["rank"] == 1} == {(2, 1.0)} and {x.patient_id for x in out} == {5}
    assert autoencoder.rank(asked, small.profile_term, model, terms, "cosine").count() == 3


def test_dictionary(spark):
    labels = spark.createDataFrame([("T1", "Big hands", 1), ("T2", "hands", 2), ("T3", "no-hands", 3), ("T4", "ha ha", 4), ("T5", "BIG  Hands!", 5)], "term string, label string, ord int")
    lookup = extraction.label_lookup(labels)
    assert {tuple(x) for x in lookup.collect()} == {("big hands", "T5", 1), ("hands", "T2", 2), ("no hands".replace(" ", "-"), "T3", 3), ("ha ha", "T4", 4)}
    texts = spark.createDataFrame([(1, "Big hands, and BIG-HANDS? handsome no-hands."), (2, "ha ha ha ha ha"), (3, None), (4, "")], "k long, text string")
    got = {(x.k, x.term, x.start, x.end, x.negated) for x in extraction.dictionary(texts, "k", lookup, skip_negated=False).collect()}
    clean = "big hands and big-hands handsome no-hands"
    want = {(1, "T5", 0, 9, False), (1, "T2", 4, 9, False), (1, "T2", clean.index("-hands") + 1, clean.index("-hands") + 6, False)}
    at = clean.index("no-hands")
    want |= {(1, "T3", at, at + 8, False), (1, "T2", at + 3, at + 8, True), (2, "T4", 0, 5, False), (2, "T4", 6, 11, False)}
    assert got == want
    with pytest.raises(ValueError, match="unknown"):
        extraction.ensemble(texts, "k", labels, ["nothing"])
    assert {x.term for x in extraction.ensemble(texts, "k", labels, blocked=spark.createDataFrame([("T2",)], "term string")).collect()} == {"T5", "T3", "T4"}


def test_phrases_against_brute_force(spark):
    names = ["muscular weakness of arms", "weak", "weakness", "abnormal gait", "gait", "a", "tall stature", "stature", "very tall stature"]
    phrases = ["weakness", "muscular weakness", "abnormal gait pattern", "xx", "tall stature", "gait", "abnormalgait", "eak"]
    lookup = spark.createDataFrame([(n, f"T{i}", i) for i, n in enumerate(names)], "name string, term string, ord int")
    asked = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    for rule, (l, m) in extraction.RULES.items():
        want = {}
        for p in phrases:
            near = [i for i, n in enumerate(names) if len(n) >= l and len(p) >= m and (p in n or n in p)]
            if p in names or near:
                want[p] = f"T{names.index(p) if p in names else near[0]}"
        assert {x.phrase: x.term for x in extraction.match_phrases(asked, lookup, rule).collect()} == want


def test_answers(spark):
    raw = "[INST] DISEASE: p | ORDO: ORPHA:9 | MATCH: q | CONFIDENCE: high [/INST]\nDISEASE: Foo bar | ORDO: ORPHA58 | MATCH: tall,\n thin | CONFIDENCE: Strong\nDISEASE: Baz | ORDO: X:1 | MATCH: m | CONFIDENCE: weak [SOLUTION]"
    df = spark.createDataFrame([(1, raw), (2, ""), (3, None)], "k int, text string")
    assert [tuple(x) for x in answers.records(df, "k").collect()] == [(1, 0, "Foo bar", "ORPHA:58", "tall, thin", "strong"), (1, 1, "Baz", "X:1", "m", "weak")]
    profiles = spark.createDataFrame([("ORPHA58", "Foo", 1), ("ORPHA:7", "Great Baz disease", 2), ("ORPHA:8", "baz", 3)], "disease_id string, label string, ord int")
    out = answers.ranked_answers(df, "k", profiles).orderBy("rank").collect()
    assert [(x.matched_id, x.label, x.validated, x.score) for x in out] == [("ORPHA58", "Foo", True, 0.9), ("ORPHA:7", "Great Baz disease", True, 0.3)]
    said = "CLINICAL REASONING:\nfits well.\nmore\nVERDICT: STRONG MATCH\nindeed\nVERDICT REASON: both"
    said2 = "One. Two. Three. Four."
    e = spark.createDataFrame([(said,), (said2,), ("",), (None,)], "t string").select(answers.explanation(F.col("t")).alias("e")).select("e.*").collect()
    assert tuple(e[0]) == ("fits well. more", "STRONG MATCH indeed", "both", "fits well. more | Verdict: STRONG MATCH indeed | both")
    assert (e[1].text, e[2].text, e[3].text) == ("One. Two. Three.", answers.NO_ANSWER, answers.NO_ANSWER)
    p = spark.range(1).select(answers.retrieval_prompt(F.lit(" ill "), F.array(F.lit("tall")), 5).alias("p"), answers.disease_preview(F.lit("D"), F.lit("x" * 500), F.array().cast("array<string>")).alias("d")).first()
    assert "Clinical description: ill\nPatient phenotypes: tall" in p.p and len(p.d) == len("Disease: D\nDescription: ") + 400


def test_explanation_lists(spark, small):
    pairs = spark.createDataFrame([(9, 1, 0.5)], "patient_id long, disease_id long, score double")
    patient = spark.createDataFrame([(9, "B"), (9, "D"), (9, "A")], "patient_id long, term string")
    raw = patient.where("term = 'B'")
    excluded = spark.createDataFrame([(9, "C")], "patient_id long, term string")
    e = explain.terms(pairs, patient, raw, small.profile_term, small.ic, excluded, small.profile_term.limit(0)).first()
    assert [x.term for x in e.matched] == ["B"] and e.matched[0].match_type == "direct" and [x.term for x in e.unmatched] == ["D", "A"] and [x.term for x in e.excluded] == ["C"]
    assert (e.conflicts.n_clash, e.conflicts.applied_penalty) == (1, 0.125) and e.components.n_union == 4 and "1 of 3" in e.summary


def test_registry(spark, small, tmp_path):
    asked = spark.createDataFrame([(1, "B"), (2, "D")], "patient_id long, term string")
    names = ["set_jaccard", "semantic_lin_bma", "tfidf_hpo", "tfidf_hybrid", "tfidf_hpo_labels", "set_jaccard_penalized"]
    best = {(x.method, x.patient_id): x.disease_id for x in registry.run(names, small, asked).where("rank = 1").collect()}
    assert all(best[(m, 2)] == 2 for m in names)
    for wrong in ([], ["nothing"]):
        with pytest.raises(ValueError):
            registry.run(wrong, small, asked)
    assert registry.resolve("Set-Jaccard") == "set_jaccard" and registry.resolve("penalized") == "set_jaccard_penalized"
    with pytest.raises(ValueError):
        registry.resolve("set")
    registry.run_batch(["set_dice"], small, asked.where("patient_id = 1"), str(tmp_path / "runs"))
    registry.run_batch(["set_dice"], small, asked, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).where("rank = 1").count() == 2


def test_comparison_cells(spark):
    df = spark.createDataFrame([("3.0", "['a', 'b']", "MME_summary.tsv"), ("", "a", "x"), ("no", " ", "y.json"), ("12", "[]", "z_results")], "r string, l string, n string")
    got = df.select(comparison.rank_cell(F.col("r"), 10), comparison.list_cell(F.col("l")), comparison.dataset_name(F.col("n"), {"x": "Set X"})).collect()
    assert [tuple(x) for x in got] == [(3, ["a", "b"], "MME"), (None, ["a"], "Set X"), (None, [], "Y"), (None, [], "Z")]
    rows = spark.createDataFrame([(1, "m", "a", 0.9, None), (1, "m", None, 0.8, 1), (1, "m", "b", 0.7, 2)], "case_id int, method string, disease_id string, score double, given int")
    assert {(x.disease_id, x["rank"]) for x in comparison.given_ranks(rows, 3).collect()} == {("b", 2), ("a", 3)}
    import pandas as pd

    names, m = "abcd", np.array([[1, 0, 0.9, 0], [0, 1, 0, 0.8], [0.9, 0, 1, 0.1], [0, 0.8, 0.1, 1]])
    order = comparison.seriate(pd.DataFrame([(names[i], names[j], m[i, j]) for i in range(4) for j in range(4)], columns=["method_a", "method_b", "jaccard"]))
    assert {frozenset(order[:2]), frozenset(order[2:])} == {frozenset("ac"), frozenset("bd")}


def test_mean_pool_and_identifiers(spark):
    tokens = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0)], "k int, vector array<double>, mask int")
    assert {(x.k, tuple(x.vector)) for x in dense.gathered(dense.mean_pool(tokens, "k"), "k").collect()} == {(1, (2.0, 3.0)), (2, (0.0, 0.0))}
    df = spark.createDataFrame([(["http://x/Orphanet_58x", " Orphanet_59 ", "ORPHA:1"],), (["x", "Orphanet: 7"],), ([],)], "m array<string>")
    assert [x[0] for x in df.select(identifiers.orpha_in_matches(F.col("m"))).collect()] == ["ORPHA:59", "ORPHA:7", None]
    refs = spark.createDataFrame([(["Orphanet:58", "ORPHANET:59", "ORPHA:60x", "MIM:1", "OMIM:2"],)], "r array<string>")
    assert refs.select(identifiers.identifiers_in(F.col("r"), "ORPHA"), identifiers.identifiers_in(F.col("r"), "OMIM")).first()[:] == (["ORPHA:58", "ORPHA:59"], ["OMIM:1", "OMIM:2"])
    t = spark.createDataFrame([("a tion btion",), ("",)], "t string").select(text.starts_of(F.col("t"), "tion")).collect()
    assert [x[0] for x in t] == [[2, 8], []]
