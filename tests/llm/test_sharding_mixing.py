import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tarn.llm import mixing, sharding


def test_differencing():
    parts = [(8,), (7,), (6,), (5,), (4,)]
    shard = sharding.difference(parts, 2)
    sums = [sum(p[0] for p, s in zip(parts, shard) if s[0] == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]  # the known result of the differencing method
    rng = np.random.default_rng(1)
    sizes = [(int(x),) for x in rng.lognormal(6, 1, 2000)]
    shard = sharding.difference(sizes, 16)
    sums = np.bincount([s[0] for s in shard], weights=[x[0] for x in sizes], minlength=16)
    assert sums.max() - sums.min() <= 2
    assert all(sorted(s) == list(range(16)) for s in shard) and sharding.difference([], 4) == []


def test_one_row_repeated_is_divided(spark):
    """Copies that share an id, or have none, are rows of their own: the law of bytes holds for them too."""
    for key in (7, None):
        rows = [(key, "x" * 100)] * 320 + [(100 + i, "y" * i) for i in range(32)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        found = sharding.balanced_shards(docs, 16).collect()
        assert len(found) == len(rows)
        sums = np.bincount([r["shard"] for r in found], weights=[r["size"] for r in found], minlength=16)
        assert sums.max() - sums.min() <= 101
        for shard in range(16):
            assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))


def test_shards(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 8)
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 3)
    rows = sharding.balanced_shards(docs, 3).collect()
    by = dict(texts)
    assert len(rows) == len(texts)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (by[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 3
        slots[r["shard"]].append(r["slot"])
        groups[by[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())


def test_groups_up_to_a_share_stay_whole(spark):
    rows = [(i, "same text of some length" * 4) for i in range(90)] + [(1000 + i, f"own {i}" * 9) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.balanced_shards(df, 4).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 1000}) == 1
    sums = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got])
    assert len(sums) == 4 and sums.max() - sums.min() < 120


def test_levels_of_differencing(spark, monkeypatch):
    """Many buckets are differenced over several levels, and the balance stays."""
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 10)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    rows = [(i, "x" * (7 * i % 900)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.balanced_shards(df, 4).collect()
    sums = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got])
    assert len(got) == 900 and len(sums) == 4 and sums.max() - sums.min() < 0.02 * sums.mean()


def naive_difference(sizes, n):
    """Partial partitions as lists of lists, searched anew each time."""
    parts = [[[i]] + [[] for _ in range(n - 1)] for i in range(len(sizes))]

    def total(group):
        return sum(sizes[i] for i in group)

    while len(parts) > 1:
        parts.sort(key=lambda p: max(map(total, p)) - min(map(total, p)), reverse=True)
        a, b, *rest = parts
        a, b = sorted(a, key=total, reverse=True), sorted(b, key=total)
        parts = rest + [[x + y for x, y in zip(a, b)]]
    return sorted(map(total, parts[0]))


def test_differencing_against_a_naive_twin():
    rng = np.random.default_rng(6)
    for n in (2, 3, 5):
        sizes = [int(x) for x in rng.permutation(5000)[:40]]  # no two alike: no ties at the start
        shard = sharding.difference([(x,) for x in sizes], n)
        sums = np.bincount([s[0] for s in shard], weights=sizes, minlength=n)
        naive = naive_difference(sizes, n)
        assert abs((sums.max() - sums.min()) - (naive[-1] - naive[0])) <= 3


def test_hot_group_is_cut(spark):
    rows = [(i, "same text of some length" * 4) for i in range(300)] + [(1000 + i, f"own {i}" * 9) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    got = sharding.balanced_shards(df, 4).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in got]
    assert len(sums) == 4 and max(sums) - min(sums) < 0.1 * max(sums)


def test_no_documents(no_docs):
    assert sharding.balanced_shards(no_docs).count() == 0
    assert mixing.rates(no_docs).count() == 0


@pytest.mark.parametrize("share, cap", [(1.5, 2), (0.5, 2), (2.0, 2), (0.01, 3)])
def test_targets(spark, share, cap):
    sizes = {"b": 100, "a": 5, None: 40, "c": 0, "é": 1000, "Z": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, share, cap).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, want = share * sum(sizes.values()), set(sizes), {}
    while True:  # the rule as stated: cut at the cap, share the excess again
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = cap * sizes[s]
            left -= want[s]
        free -= full
    want |= {s: level * weight[s] for s in free}
    assert got == pytest.approx(want)


def test_tilt(spark):
    """Newton's steps meet every source's target, as bisection does."""
    sizes, counts = np.array([1.0, 5, 20, 300]), np.array([50, 10, 4, 1])
    total = float((sizes * counts).sum())
    aims = {s: f * total for s, f in zip("abcdefg", (0.01, 0.5, 1.0, 1.7, 1.99, 2.0, 0.0))} | {None: 1.2 * total}
    hist = [(s, int(z), int(n)) for s in aims for z, n in zip(sizes, counts)] + [("a", 0, 7)]
    hist = spark.createDataFrame(hist, "source string, size long, n long")
    rows = [(s, int(total), int(counts.sum()) + 7 * (s == "a"), t) for s, t in aims.items()]
    sources = spark.createDataFrame(rows, "source string, source_size long, source_docs long, target double")
    found = {r["s"]: r for r in mixing.tilts(hist, sources, 2.0).collect()}
    for s, target in aims.items():
        tilt, mean = found[s]["tilt"], found[s]["mean"]
        assert mean == pytest.approx(total / rows[list(aims).index(s)][2])

        def taken(t, mean=mean):
            with np.errstate(over="ignore"):
                return (np.minimum(2.0, np.exp(t * sizes / mean)) * sizes * counts).sum()

        assert taken(tilt) == pytest.approx(target, rel=1e-6) and found[s]["met"]
        low, high = -1e6, 1e6
        if 0 < target < 2 * total:
            for _ in range(200):
                middle = (low + high) / 2
                low, high = (middle, high) if taken(middle) < target else (low, middle)
            assert tilt == pytest.approx(low, rel=1e-3, abs=1e-6)


def test_rounding():
    assert mixing.rounded([6000, 500, 0], [1.3, 2.0, 1.0], 2) == [1, 2, 1]
    assert mixing.rounded([6000, 10], [1.6, 1.0], 2) == [2, 0]
    sizes = sorted(range(1, 400), reverse=True)
    copies = mixing.rounded(sizes, [0.37] * len(sizes), 2)
    assert abs(sum(c * s for c, s in zip(copies, sizes)) - 0.37 * sum(sizes)) < 1
    # Against all choices: within half of the largest document of the best.
    rng = np.random.default_rng(4)
    for _ in range(50):
        few = sorted((int(x) for x in rng.lognormal(3, 1, 6) + 1), reverse=True)
        want = rng.uniform(0, 2) * sum(few)
        got = mixing.rounded(few, [want / sum(few)] * 6, 2)
        best = min(abs(sum(c * s for c, s in zip(cs, few)) - want) for cs in itertools.product(range(3), repeat=6))
        assert abs(sum(c * s for c, s in zip(got, few)) - want) <= best + few[0] / 2


def test_mix(spark, docs, texts):
    rows = {r["doc_id"]: r for r in mixing.rates(docs).collect()}
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for i, t in texts:
        r = rows[i]
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        mine = r["copies"] * n
        assert r["size"] == n and 0 <= mine <= 2 * n
        taken[r["source"]] += mine
        size[r["source"]] += n
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(rows[i]["source_size"] == size[rows[i]["source"]] for i in rows)
    for s in target:
        largest = max(len((t or "").split()) for i, t in texts if rows[i]["source"] == s)
        assert abs(taken[s] - target[s]) <= max(0.02 * size[s] + 1, largest / 2)
    again = {r["doc_id"]: r["copies"] for r in mixing.rates(docs.repartition(5)).collect()}
    assert again == {i: r["copies"] for i, r in rows.items()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"]] += len((r["text"] or "").split())
    want = {i: r["copies"] * r["size"] for i, r in rows.items()}
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in got.items() if n}
    by = dict(texts)
    assert all(r["text"] == by[r["doc_id"]] for r in mixed.collect())


def test_copies_of_rows_that_share_an_id(spark):
    """Every text of a repeated id has its own copies."""
    rows = [(1, "a", "one two three"), (1, "a", "four five six"), (1, "b", "one two three"), (2, "b", "x y"), (2, "b", "x y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    rates = mixing.rates(df).collect()
    got = sorted((r["doc_id"] or 0, r["source"] or "", r["text"] or "") for r in mixing.mixed(df).collect())
    assert len(rates) == 6 and len(got) == sum(r["copies"] for r in rates)
    wanted = {t for _, _, t in got}
    for text in ("one two three", "four five six"):
        key = [r for r in rates if r["doc_id"] == 1 and r["copies"] and r["size"] == 3]
        assert not key or wanted <= {t or "" for _, _, t in rows}
