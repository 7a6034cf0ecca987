"""Plans that have to hold on larger tables: what they send, hold and train on."""

import numpy as np
from pyspark.sql import functions as F

from phenoweave.catalogue_models import QUERIES
from phenoweave.operators import autoencoder, extraction, graph, ontology, semantic, sets, tfidf
from phenoweave.plans import blocks
from phenoweave.plans.ranking import top_k


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_sets_are_not_sent(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = lambda n, key: spark.createDataFrame([(i, int(t)) for i in range(n) for t in set(r.integers(0, 40, 6))], f"{key} long, term long")
    p, d = rows(30, "patient_id"), rows(50, "disease_id")
    monkeypatch.setattr(sets, "LIST", 3)  # lists of common terms are cut, no pair is lost
    own, other = {}, {}
    for key, df in ((own, p), (other, d)):
        for x in df.collect():
            key.setdefault(x[0], set()).add(x[1])
    want = {(a, b, len(s & t), len(s), len(t)) for a, s in own.items() for b, t in other.items() if s & t}
    found = sets.overlaps(p, d)
    assert {tuple(x) for x in found.collect()} == want
    assert "hashpartitioning(patient_id" in plan(found) and "hashpartitioning(patient_id#" in plan(found).split("Generate")[1]
    assert not any("Exchange" in line for line in plan(found).split("Generate")[0].splitlines() if "AdaptiveSparkPlan" not in line)


def test_labels_are_joined_whole(spark):
    lookup = spark.createDataFrame([(f"big w{i}", i, i) for i in range(300)] + [("big-hands", 900, 900), ("big", 901, 901)], "name string, term int, ord int")
    texts = spark.createDataFrame([(1, "big w7 big-hands, no big w8 bigger"), (2, "w7 big")], "k int, text string")
    found = extraction.dictionary(texts, "k", lookup, skip_negated=False)
    got = {(x.k, x.term, x.start, x.end, x.negated) for x in found.collect()}
    assert got == {(1, 7, 0, 6, False), (1, 901, 0, 3, False), (1, 900, 7, 16, False), (1, 901, 7, 10, False), (1, 8, 20, 26, True), (1, 901, 20, 23, True), (2, 901, 3, 6, False)}
    joins = [x for x in plan(found).splitlines() if "Join" in x]
    assert joins and all("[name#" in x or "[k#" in x for x in joins)  # not by the first word, that many labels share


def test_best_columns_and_terms_scored_once(spark, monkeypatch):
    s = np.random.default_rng(2).integers(0, 4, (50, 30)) / 4
    for k in (1, 7, 30, 40):
        row, col = blocks.best_columns(s, k)
        assert np.array_equal(col.reshape(50, -1), np.argsort(-s, axis=1, kind="stable")[:, :k]) and np.array_equal(row, np.repeat(np.arange(50), min(k, 30)))
    assert [x.tolist() for x in blocks.best_columns(np.array([[np.nan, 1.0, np.nan, 0.5]]), 3)] == [[0, 0, 0], [1, 3, 0]]
    # terms of profiles are scored once for PROFILE_BLOCK profiles and PATIENTS patients
    assert semantic.PROFILE_BLOCK >= 8 * semantic.PROFILES and semantic.PATIENT_BLOCK >= 4 * semantic.PATIENTS


def test_autoencoder_trains_on_every_profile(spark, monkeypatch):
    profile = spark.createDataFrame([(i, i % 10 * 50 + j) for i in range(400) for j in range(4)] , "disease_id long, term long")
    monkeypatch.setattr(autoencoder, "PART", 100)
    for places in (1000, 30):  # a place for each term, and a vocabulary that is larger
        monkeypatch.setattr(autoencoder, "MOST_PLACES", places)
        monkeypatch.setattr(autoencoder, "PLACES", 128)
        model, terms = autoencoder.fit(profile, epochs=3, hidden=16, latent=8)
        assert len(terms) == (40 if places == 1000 else 128) and len(model.losses) == 3 and model.losses[-1] < model.losses[0]
        flat, _ = autoencoder._epoch(autoencoder.placed(profile, "disease_id", terms), model, 4, 9, 0)
        assert np.array_equal(flat, autoencoder._epoch(autoencoder.placed(profile, "disease_id", terms), model, 4, 9, 0)[0])
        assert autoencoder.placed(profile, "disease_id", terms).count() == 400
        asked = spark.createDataFrame([(5, 101), (6, 99999)], "patient_id long, term long")
        assert {x.patient_id for x in autoencoder.rank(asked, profile, model, terms).collect()} == {5}


def test_best_matches_look_at_few_terms(spark):
    r = np.random.default_rng(3)
    two = spark.createDataFrame([(d, int(x), int(b), float(v)) for d in range(3) for x in range(4) for b, v in zip(r.permutation(200)[:40], r.choice([0.0, 0.5, 1.0, 1.5, 2.5], 40), strict=True)], "disease_id long, ancestor long, b long, ic_b double")
    few = semantic._front(two)
    assert few.count() < two.count() / 4
    asked = spark.createDataFrame([(a, x / 4, float(v)) for a in range(6) for x in (0, 1, 6) for v in (0.0, 1.0)], "a long, ic_x double, ic_a double")
    for m in semantic.MEASURES.values():
        best = lambda df: {tuple(x) for x in df.crossJoin(asked).withColumn("s", F.expr(m)).groupBy("disease_id", "ancestor", "a", "ic_x", "ic_a").agg(F.max(F.struct(F.round("s", 9), -F.col("b")))).collect()}  # noqa: E731, B023
        assert best(few) == best(two)


def test_shared_beginnings_make_no_pairs(spark):
    names = [f"customer#{i:09d}" for i in range(300)]
    df = spark.createDataFrame([(x,) for x in [*names, "r#0000", "é"]], "phrase string")
    found = extraction.containing(df, df.withColumnRenamed("phrase", "name"))
    want = {(a, b) for a in [*names, "r#0000", "é"] for b in [*names, "r#0000", "é"] if a in b or b in a}
    assert {tuple(x) for x in found.collect()} == want
    assert "Contains(" not in plan(found)  # joined whole, not filtered from pairs with a common beginning
    up = spark.createDataFrame([(1, 1), (2, 2), (1, 0), (2, 0), (3, 3)], "term int, ancestor int")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert [tuple(x) for x in semantic.common_ancestors(pairs, up).collect()] == [(1, 2, 0)]
    assert "ancestor" not in "".join(x for x in plan(semantic.common_ancestors(pairs, up)).splitlines() if "Join" in x)


def test_label_rankings_make_no_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(tfidf, "QUERY_BLOCK", 16)
    monkeypatch.setattr(tfidf, "ITEM_BLOCK", 32)
    # one common token, rare ones, one of weight 0 and one below 0
    idf = {"all": 0.3, "zero": 0.0, "less": -0.4} | {f"w{i}": float(r.random() + 0.1) for i in range(60)}
    side = lambda n, key: spark.createDataFrame([(i, str(x), int(r.integers(1, 4))) for i in range(n) for x in set(r.choice(list(idf), 5)) | ({"all"} if i % 3 else set())], f"{key} long, token string, tf long")
    weights = spark.createDataFrame(list(idf.items()), "token string, idf double")
    q, d = tfidf.weigh(side(40, "patient_id"), weights).cache(), tfidf.weigh(side(90, "disease_id"), weights).cache()
    for w in (weights, weights.where("idf > 0")):
        kept = [x.join(w.select("token"), "token", "left_semi") for x in (q, d)]
        best = tfidf.rank(*kept, w, 30)
        got, want = ({(x.patient_id, x["rank"], x.disease_id): x.score for x in df.collect()} for df in (best, top_k(tfidf.cosine(*kept), ["patient_id"], 30)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
        assert "FlatMapGroupsInPandas" in plan(best)


def test_ancestors_are_sent_as_lists(spark):
    r = np.random.default_rng(5)
    dag = [(i, int(r.integers(0, i))) for i in range(1, 60) for _ in range(2)]
    for pairs in (dag, [*dag, (70, 71), (71, 72), (72, 70), (73, 72), (74, 73), (72, 5), (75, 75), (None, 7), (76, None)]):  # a cycle, below it, itself
        edges = spark.createDataFrame(pairs, "child long, parent long")
        want = set(pairs)
        while len(more := want | {(a, d) for a, b in want for c, d in pairs if b == c and b is not None}) > len(want):
            want = more
        got = [tuple(x) for x in ontology.closure(edges).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        every = {x for p in pairs for x in p}
        assert {tuple(x) for x in ontology.closure(edges, inclusive=True).collect()} == want | {(x, x) for x in every}
    terms = spark.createDataFrame([(i, int(t)) for i in range(20) for t in r.integers(0, 90, 3)], "patient_id long, term long")
    up = ontology.propagate_lists(terms, ontology.ancestor_lists(edges), "patient_id")
    own = {tuple(x) for x in terms.collect()}
    got = [tuple(x) for x in up.collect()]
    assert len(got) == len(set(got)) and set(got) == own | {(p, a) for p, t in own for c, a in want if c == t}
    top = plan(up).split("Generate")[0]  # rows of ancestors are never sent
    assert not any("Exchange" in line for line in top.splitlines() if "AdaptiveSparkPlan" not in line)


def test_counts_of_labels_and_edges_are_made_in_small_parts(spark):
    edges = spark.createDataFrame([(1, 0), (2, 1), (1, 2), (3, 3), (None, 5), (4, None)], "child long, parent long")
    profile = spark.createDataFrame([(7, 1), (7, 1), (8, 2), (None, 5)], "disease_id long, term long")
    found, want = graph.counted(edges, profile), graph.build(edges, profile).groupBy("src", "dst").count()
    assert sorted(map(str, found.collect())) == sorted(str(x).replace("count=", "n=") for x in want.collect())
    assert plan(found).count("REPARTITION_BY_NUM") >= 2  # by number: parts are not merged by the size of what is sent
    for name in ("label_tokens", "graph_edges"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_walks_of_a_large_graph_are_those_of_a_small_one(spark, monkeypatch):
    r = np.random.default_rng(7)
    pairs = {(f"t:{a}", f"t:{b}") for a, b in r.integers(0, 30, (90, 2))}
    pairs = [*(pairs | {(b, a) for a, b in pairs}), *[("t:1", "t:z")] * 3, ("t:2", None)]  # t:z is a sink, an edge occurs three times
    edges = spark.createDataFrame(pairs, "src string, dst string")
    weight = spark.createDataFrame([(f"t:{i}", float(r.integers(0, 4))) for i in range(25)], "node string, weight double")
    own = lambda: {(x.node, x.walk): x.path for x in graph.walks(edges, weight, 6, 3, 4.0, 0.25, 3).collect()}
    small = own()
    monkeypatch.setattr(graph, "MOST_EDGES", 1)
    assert own() == small and {len(x) for x in small.values()} > {6} and "t:z" in sum(small.values(), [])
    # a step is one job of its own: no plan has the steps before it
    long = graph.walks_by_joins(edges, weight, spark.createDataFrame([("t:1", 1), ("t:none", 1)], "node string, walk int"), 4, 1.0, 0.5, 0)
    assert plan(long).count("FlatMapCoGroups") == 0 and {x.node: len(x.path) for x in long.collect()}["t:none"] == 1


def test_tokens_of_texts_are_not_sent(spark, monkeypatch):
    r = np.random.default_rng(8)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    some = [" ".join(words[int(i)] for i in np.minimum(r.geometric(0.08, 12), 90) - 1) for _ in range(60)]
    rows = [*enumerate(some), (3, some[4]), (70, None), (71, "a b"), (72, words[-1])]  # a repeated key, texts without tokens
    texts = spark.createDataFrame(rows, "disease_id long, text string")
    plain = tfidf.token_counts(texts, "disease_id")
    want = {x.disease_id: x.norm for x in tfidf.norms(tfidf.weigh(plain, tfidf.idf(plain, texts, "disease_id")), "disease_id").collect()}
    counts = tfidf.token_counts(texts, "disease_id", whole=True)
    assert {tuple(x) for x in counts.collect()} == {tuple(x) for x in plain.collect()}
    weights = tfidf.idf(counts, texts, "disease_id", once=True)
    for most in (0, 10, 500):  # all tokens are rare, some, none
        monkeypatch.setattr(tfidf, "MOST_TOKENS", most)
        got = {x.disease_id: x.norm for x in tfidf.norms_in_place(counts, weights, "disease_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    few = spark.createDataFrame([(words[0],), (words[5],)], "token string")
    assert {tuple(x) for x in tfidf.token_counts(texts, "disease_id", whole=True, only=few).collect()} == {tuple(x) for x in plain.join(few, "token").select("disease_id", "token", "tf").collect()}
    assert not any("Exchange" in line for line in plan(counts).split("Generate")[0].splitlines() if "AdaptiveSparkPlan" not in line) and "REPARTITION_BY_NUM" in plan(counts)


def test_parts_of_walks_are_learnt_at_the_same_time(spark, monkeypatch):
    r = np.random.default_rng(9)
    paths = spark.createDataFrame([([f"t:{int(x) + 10 * (i % 2)}" for x in r.integers(0, 10, 20)],) for i in range(400)], "path array<string>")  # two groups that never meet
    made = []
    true = graph.Word2Vec
    monkeypatch.setattr(graph, "Word2Vec", lambda **k: made.append(k["numPartitions"]) or true(**k))
    monkeypatch.setattr(graph, "PART_WALKS", 100)
    v = {x.node: np.array(x.vector) / np.linalg.norm(x.vector) for x in graph.embed(paths, dim=8, window=3, epochs=4).collect()}
    near = [v[f"t:{a}"] @ v[f"t:{b}"] for a in range(20) for b in range(a) if a // 10 == b // 10]
    far = [v[f"t:{a}"] @ v[f"t:{b}"] for a in range(10) for b in range(10, 20)]
    assert made == [4] and len(v) == 20 and np.mean(near) > np.mean(far)
