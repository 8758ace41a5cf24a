import random

import numpy as np
import pytest

from tarn.llm import topk

SCHEMA = "vec_id long, v array<long>, extra string"


def brute(rows, asked, k):
    """Rows are rows: those that share an id each ask, and each is a candidate for all but itself."""
    clean = [(i, v) for i, v, _ in rows if i is not None and v is not None and None not in v]
    out = []
    for at, (q, x) in enumerate(clean):
        if q in asked:
            scored = [(-sum(a * b for a, b in zip(x, v)), i) for other, (i, v) in enumerate(clean) if other != at]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_matches_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 60)
    rng = random.Random(k)
    rows = [(i, [rng.randrange(-9, 9) + 20 * (i % 3) for _ in range(6)], "x") for i in range(240)]
    rows += [(1000 + i, [5, 5, 5, 5, 5, 5], "hot") for i in range(120)]  # ties among equal vectors
    rows += [(2000, None, "null"), (2001, [1, None, 2, 3, 4, 5], "hole"), (2002, [7, 7], "short"), (None, [1] * 6, "no id")]
    rows += [(7, [0] * 6, "again"), rows[11], rows[40], rows[40], (60, [8] * 6, "again"), (1000, [5] * 6, "hot")]
    asked = [i for i, _, _ in rows if i is not None and i % 20 == 0]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, asked, k)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1, 2], "a"), (1, [3, 4], "b")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, df, 20).orderBy("query_id").collect()] == [(0, 1, 1, 11), (1, 1, 0, 11)]
    assert topk.top_k(df.limit(0), df, 20).count() == 0
    assert topk.top_k(df, df.limit(0), 20).count() == 0


def test_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.01]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "i int, embedding array<float>")
    got = {r[0]: r[1] for r in df.select("i", topk.whole_components()).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None}


def test_dual_traversal_prunes():
    rng = np.random.default_rng(0)
    centres = rng.integers(-400, 400, (6, 8))
    x = (centres[rng.integers(0, 6, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(float)
    queries, refs = topk.CoverTree(x[:300]), topk.CoverTree(x)
    found = topk.Search(queries, refs, 10, np.full(300, -np.inf)).run()
    want = -np.sort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert (found.score == want).all()
    again = topk.Search(queries, refs, 10, found.worst)
    compared = sum(len(queries.members[a]) * len(refs.members[b]) for a, b, _ in zip(*again.pairs()))
    assert compared < 0.6 * 300 * 4000
    for node, inner in enumerate(refs.children):
        for child in inner:  # every ball holds the points below it
            below = refs.members[child]
            if below is not None:
                assert (np.linalg.norm(x[below] - x[refs.centre[child]], axis=1) <= refs.radius[child] + 1e-9).all()


def test_laws_of_the_tree():
    """Children's centres are as far apart, at least, as the farthest of their points is from its centre."""
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (3000, 5)).astype(float)
    tree = topk.CoverTree(x)

    def below(node):
        return tree.members[node] if tree.members[node] is not None else np.concatenate([below(c) for c in tree.children[node]])

    for node, inner in enumerate(tree.children):
        if len(inner) > 1:
            centres = x[[tree.centre[c] for c in inner]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(len(inner), dtype=bool)].min()
            covered = max(np.linalg.norm(x[below(c)] - x[tree.centre[c]], axis=1).max() for c in inner)
            assert apart >= covered - 1e-9
    assert sorted(below(0)) == list(range(3000))
