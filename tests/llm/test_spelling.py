import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarn.llm import spelling

LETTERS = "abcdeéß"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts: dict[str, int]) -> dict[str, tuple]:
    """(form, root, n, n_near, form_n) of every word by comparing all words."""
    best, near = {}, {}
    for w in counts:
        others = [v for v in counts if v != w and one_edit(v, w)]
        near[w] = len(others)
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        best[w] = top if top is not None and counts[top] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while best[root] is not None:
            root = best[root]
        out[w] = (best[w], root, counts[w], near[w], counts.get(best[w]))
    return out


@pytest.fixture(scope="module")
def vocabulary():
    """Words of few letters, so that many are near: anagrams, chains of forms, long ones, ties."""
    rng = random.Random(3)
    words = {"".join(rng.choice(LETTERS) for _ in range(rng.randrange(7, 11))) for _ in range(500)}
    words |= {"".join(rng.sample("abcdefg", 7)) for _ in range(150)} | {"a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 150}
    counts = {w: rng.choice([2, 2, 2, 3, 25, 25, 400, 9000]) for w in sorted(words)}
    return counts | {"chainaaa": 2, "chainaab": 20, "chainabb": 200, "chainbbb": 2000, "chaincbbb": 20_000, "chaincbba": 20_000}


@pytest.mark.parametrize("cell", [12, 100_000])
def test_against_all_pairs(spark, vocabulary, cell):
    words = spark.createDataFrame(sorted(vocabulary.items()), "word string, n long").repartition(3)
    found = spelling.grouped(words, cell=cell).collect()
    assert len(found) == len(vocabulary)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == variants(vocabulary)


def test_cuts_and_parts_hold_every_word(vocabulary):
    words = sorted(w for w in vocabulary if len(w) == 7)
    tree = spelling.Cuts.of(spelling.counts(spelling.letters(words)), len(words), 8)
    rows, cells = tree.reach(spelling.counts(spelling.letters(words)), 0, 0)
    assert sorted(rows) == list(range(len(words))) and len(set(cells)) > 4
    anagrams = ["".join(random.Random(k).sample("abcdefg", 7)) for k in range(100)]
    one = spelling.Cuts.of(spelling.counts(spelling.letters(anagrams)), 100, 8)
    assert one.letter == [-1] and one.parts == [7]


def test_bits_differ_no_more_than_letters(vocabulary):
    words = [w for w in vocabulary if len(w) == 8]
    v = spelling.counts(spelling.letters(words))
    b = spelling.bits(v)
    for i in range(0, len(words), 7):
        assert (np.bitwise_count(b[i] ^ b).sum(axis=1) <= np.abs(v[i].astype(int) - v).sum(axis=1)).all()


def test_words_and_deletions(spark):
    texts = [(i, f"Überweisung überweisung, straßenbahn's ÉTÉS×été x{i}y Strassenbahn-strassenbahn {'z' * 5000}") for i in range(90)]
    texts += [(None, "straßenbahn straßenbahn"), (5, None), (6, ""), (7, "short words only"), (3, texts[3][1])]
    want: Counter = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    docs = spark.createDataFrame([(i, t, "w", 9) for i, t in texts], "doc_id long, text string, word string, n int")
    found = spelling.word_counts(docs)
    assert {r["word"]: r["n"] for r in found.collect()} == want
    assert spelling.grouped(spelling.word_counts(docs.limit(0))).count() == 0
