import itertools
import math
import re

import pytest

from tarn.llm import interaction


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)] + [(0, 1, 1), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def fails(rows):
    """The failed filters of each (doc_id, text) row, by the definitions."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = ""
        found += "A" * (len(words) < 200)
        found += "B" * (100 * len(set(words)) < 50 * len(words))
        found += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        found += "D" * bool(re.search("[#$%&*|]", text))
        found += "E" * any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t in rows)
        out.append(found)
    return out


def audit(rows, langs, labels):
    """All counts by trying every order on every document."""
    good = {r["doc_id"] for r in labels if r["doc_id"] is not None and r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels if r["doc_id"] is not None and r["toxic"] == 1}
    failed, out = fails(rows), {}
    for part in set(langs):
        mine = [(rows[k][0], failed[k]) for k in range(len(rows)) if langs[k] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                total[x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_against_every_order(spark, texts, labels):
    rows = list(texts) + [(30, "CAPITALS % AND # SIGNS " * 80), (None, ""), (None, None), (25, "word"), (21, texts[21][1])]
    rows += [(50 + i, "a % b " * (100 + i)) for i in range(4)] + [(5, "a % b " * 100), (5, "a % b " * 100)]
    langs = [("en", "de", None, "")[k % 4] for k in range(len(rows))]
    docs = spark.createDataFrame(
        [(i, t, g, 1, "x") for (i, t), g in zip(rows, langs)], "doc_id long, text string, lang string, n int, mask string"
    ).repartition(5)
    found = interaction.interactions(interaction.failures(docs, labels)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found}
    want = audit(rows, [g or "" for g in langs], labels.collect())
    assert len(found) == len(got) == 3 * 600
    assert got == want


def test_intervals_tile_the_orders():
    for mask in range(1, 32):
        found = sorted((a, b, s) for s, a, b in interaction.intervals(5, mask))
        assert [f[0] for f in found] == [0] + [f[1] for f in found[:-1]] and found[-1][1] == math.factorial(5)
        orders = list(itertools.permutations(range(5)))
        for a, b, step in found:
            assert all([mask >> f & 1 for f in orders[r]].index(1) + 1 == step for r in range(a, b))


def test_other_filters_and_empty_tables(spark, no_docs, labels):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 2), ("p", 3, 1, 1, 0)], "part string, mask int, n long, good long, toxic long")
    found = {(r["filter_order"], r["step"]): list(r)[3:] for r in interaction.interactions(cells, "XY").collect()}
    assert found == {
        ("XY", 1): [5, 3, 0, 0, 1, 2, 3], ("XY", 2): [5, 0, 3, 0, 0, 0, 3],
        ("YX", 1): [5, 3, 0, 0, 1, 2, 3], ("YX", 2): [5, 0, 3, 0, 0, 0, 3],
    }
    assert interaction.interactions(interaction.failures(no_docs, labels)).count() == 0
    assert interaction.interactions(interaction.failures(no_docs, labels.limit(0))).count() == 0
    with pytest.raises(ValueError):
        interaction.interactions(cells, "ABCDEFGH")
