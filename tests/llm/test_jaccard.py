import random
from collections import defaultdict

import numpy as np
import pytest

from phenoweave.llm import components, jaccard


def brute(rows, num=90, den=100, width=3):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append(s)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(x for x in least[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.55:
            w = (r.choice(rows[-60:])[1] or "").split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                if w:
                    j = r.randrange(len(w))
                    w[j : j + r.choice([0, 1, 1])] = r.choice([[], [r.choice(words)]])
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 14, 20, 40, 90, 200, 700])))))
    return rows


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 2, 60)])
def test_same_as_brute_force(spark, seed, width, num):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 0, 1) for r in rows], "doc_id long, text string, n string, root int, s int")
    out = jaccard.jaccard_join(docs, width, num).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, num, 100, width)


@pytest.mark.parametrize(("num", "items"), [(90, 4_000_000), (80, 600)])
def test_small_cells_and_many_near_copies(spark, monkeypatch, num, items):
    monkeypatch.setattr(jaccard, "CELL_ITEMS", items)
    monkeypatch.setattr(jaccard, "CELL", 8)
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_join(docs, 3, num).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out) == brute(rows, num)


def test_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (3, "one"), (9, "one two"), (10, "ONE  two"), (11, "ÀB c"), (12, "àb c"), (2, "a b c " * 60_000), (1, "a b c " * 50_000), (20, "same row here now"), (20, "same row here now")]
    docs = spark.createDataFrame([*rows, (None, "one"), (None, "alone in its group")], "doc_id long, text string")
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()}
    assert out == {(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (3, 1, 3), (9, 1, 9), (10, 1, 9), (11, 1, 11), (12, 1, 12), (2, 3, 1), (1, 3, 1), (20, 2, 20), (None, 1, 3), (None, 2, None)}
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_tree_loses_nothing():
    r = np.random.default_rng(0)
    points = r.poisson(4, (3000, jaccard.GROUPS)).astype(np.int32)
    points[::7] = points[0] + r.integers(0, 2, (len(points[::7]), jaccard.GROUPS))
    sizes = points.sum(1)
    tree = jaccard.CountTree(points, sizes)
    for i in range(0, 3000, 37):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(bound * 190 >= 90 * (sizes + sizes[i]))
        assert sorted(tree.search(points[i], int(sizes[i]), 90, 100).tolist()) == want.tolist()


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (67, 100), (50, 100), (99, 100)])
def test_windows_of_linked_sets_share_enough(num, den):
    r = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 5, 8, 9, 10, 11, 19, 25, 60, 150, 800, 5000]:
        for _ in range(80):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            d = n * (den - num) // num
            gone, new = (int(x) for x in r.integers(0, d + 1, 2))
            gone = r.choice(len(a), min(gone, len(a) - 1), replace=False)
            b = np.unique(np.concatenate([np.delete(a, gone), r.integers(0, 2**63, new).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                wa, wb = (s[: jaccard.window(len(s), num, den)] for s in (a, b))
                common = len(np.intersect1d(wa, wb))
                assert common >= max(jaccard.shared_in_window(len(s), num, den) for s in (a, b))
                assert len(a) + len(b) - 2 * both <= min(jaccard.differ(len(s), num, den) for s in (a, b))


def test_bounds_are_the_same_in_sql(spark):
    for num, den in [(90, 100), (80, 100), (50, 100)]:
        least = jaccard._least_sql("n", num, den)
        got = spark.range(1, 400).toDF("n").selectExpr("n", f"{jaccard._window_sql('n', num, den)} AS w", f"greatest(1, {jaccard._window_sql(f'({least})', num, den)} - {jaccard._differ_sql('n', num, den)}) AS o")
        for n, w, o in got.collect():
            assert (w, o) == (jaccard.window(n, num, den), jaccard.shared_in_window(n, num, den))


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 5000)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    for a in adj:
        if adj[a] == {a}:
            continue
        seen, todo = {a}, [a]
        while todo:
            for y in adj[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[a] == min(seen)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
