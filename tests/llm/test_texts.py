"""Decontamination, suffix dedup, near duplicates: against brute force on the fixture."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarn.llm import common, decontaminate, neardup, suffixdedup
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[key]
        out[d] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 200])
def test_contamination(spark, docs, texts, monkeypatch, limit):
    whole = prose(33 - 30 + 3, 6000).split()
    items = [
        (1, " ".join(whole[100:130])), (2, "WORD"), (10, prose(2, 60)), (3, None), (4, ""), (5, "two words"),
        (6, " ".join(words(prose(1, 120))[50:70])), (7, "never seen at all in any of these texts ever"), (10, prose(2, 60)),
        (8, "ab " * 12), (9, "..."),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = decontaminate.benchmark_blocks
    monkeypatch.setattr(decontaminate, "benchmark_blocks", lambda b: blocks(b, limit))
    found = decontaminate.contamination(docs.withColumn("n_hit", docs.size), benchmark).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found}
    assert got == brute_hits(texts, items)
    longest = {r["doc_id"]: r["longest_match"] for r in found}
    assert longest[33] == 30 and longest[29] == len(words(prose(2, 60))) and longest[0] == 0
    clean = decontaminate.decontaminated(docs.withColumn("n_hit", docs.size + 98), benchmark)
    assert clean.columns == [*docs.columns, "n_hit"] and {r["n_hit"] for r in clean.collect()} == {99}
    by = {i: words(t) for i, t in texts}
    words_of = {"1": whole[100:130], "10": prose(2, 60).split(), "6": words(prose(1, 120))[50:70], "8": ["ab"] * 12, "2": ["word"], "5": ["two", "words"]}
    words_of = {k: words(" ".join(v)) for k, v in words_of.items()}
    for r in found:
        for m in r["matches"]:
            run, item = by[r["doc_id"]][m["start"] :][: m["words"]], words_of[m["item_id"]]
            assert run == item[m["item_start"] :][: m["words"]] and len(run) == m["words"]
            # No longer: the words before and after differ, or there are none.
            before, after = m["start"] - 1, m["start"] + m["words"]
            if before >= 0 and m["item_start"] > 0:
                assert by[r["doc_id"]][before] != item[m["item_start"] - 1]
            if after < len(by[r["doc_id"]]) and m["item_start"] + m["words"] < len(item):
                assert by[r["doc_id"]][after] != item[m["item_start"] + m["words"]]
        assert {m["item_id"] for m in r["matches"]} == set(r["item_ids"])


def test_nothing_to_find(spark, docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, empty).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(no_docs, empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, 400)
    order = decontaminate.suffix_array(x, 10)
    keys = [tuple(x[i : i + 10]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(400))
    assert len(decontaminate.suffix_array(np.empty(0, np.int64), 10)) == 0


def brute_kept(rows, n=200):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def shared(spark, prefix):
    return [f for f in os.listdir(common.shared_folder(spark).removeprefix("file:")) if f.startswith(prefix)]


def test_suffix_dedup(spark, docs, texts):
    found = suffixdedup.without_repeats(docs).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert got == brute_kept(texts)
    assert hashlib.sha256(next(r["kept"] for r in found if r["doc_id"] == 29)).hexdigest() == got[29][3]


def test_suffix_edges(spark, no_docs, monkeypatch):
    assert suffixdedup.without_repeats(no_docs).count() == 0
    a, b = "x" * 199, "abcdefghij" * 20
    rows = [(0, a), (1, a), (2, b), (3, "q" + b), (4, b[:199]), (5, a + "y"), (6, "z" * 201), (7, prose(9, 300)), (8, prose(9, 300)[40:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.without_repeats(df).collect()}
    assert got == brute_kept(rows)


@pytest.mark.parametrize("most", [0, 30])
def test_suffix_dedup_of_hot_anchors(spark, texts, monkeypatch, most):
    """A phrase with other surroundings in each text, and a passage that all share: no task takes such an anchor whole."""
    monkeypatch.setattr(suffixdedup, "HOT_PLACES", most)
    phrase, passage = prose(50, 30)[:150], prose(51, 60)[:230]
    rows = texts if most == 0 else []
    rows = rows + [(100 + i, prose(200 + i // 2, 12 + i % 2) + phrase + prose(300 + i, 20) + passage + prose(400 + i // 3, 9)) for i in range(60)]
    rows += [(200, passage * 9), (201, "ab" * 300 + phrase)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = set(shared(spark, "sub-windows-"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.without_repeats(df).collect()}
    assert got == brute_kept(rows)
    assert set(shared(spark, "sub-windows-")) > before


def test_a_context_is_induced_once():
    """However many texts a context stands in, one row of runs comes out; places are joined to it later."""
    import pyarrow as pa

    right, left = bytes(range(200)), b"x" * 10
    kinds = {"anchor": pa.int64(), "cid": pa.binary(), "right": pa.binary(), "left": pa.binary(), "tid": pa.int64(), "n": pa.int32()}
    rows = [{"anchor": 1, "cid": b"c", "right": right, "left": left, "tid": t, "n": 1} for t in range(1000)]
    for given, want in ((rows, [{"cid": b"c", "first": 0, "last": 0}]), (rows[:1] * 2, [])):
        batches = [pa.RecordBatch.from_pylist(given[i : i + 300], pa.schema(list(kinds.items()))) for i in range(0, len(given), 300)]
        got = [r for b in suffixdedup._induced(iter(batches)) for r in b.to_pylist()]
        # Windows up to 10 bytes left of the anchor lie inside the context.
        assert got == [r | {"first": -10} for r in want]


def test_long_text_is_sampled_in_segments(monkeypatch):
    text = prose(11, 3000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text])], names=["tid", "text"])
    whole = {(r["anchor"], p) for b in suffixdedup._sample(iter([batch])) for r in b.to_pylist() for p in r["places"]}
    monkeypatch.setattr(suffixdedup, "SEGMENT", 1000)
    cut = {(r["anchor"], p) for b in suffixdedup._sample(iter([batch])) for r in b.to_pylist() for p in r["places"]}
    assert whole == cut


def test_repeated_runs_over_batches():
    import pyarrow as pa

    rows = [(1, 1, 0), (2, 1, 0), (2, 1, 0), (2, 2, 5), (2, 3, 1), (3, 1, 0), (3, 1, 0), (4, 9, 9), (5, 1, 1), (5, 2, 1)]
    for cut in (1, 2, 3, 4, 10):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows[i : i + cut]]) for k in range(3)] + [pa.array([[r[2]] for r in rows[i : i + cut]])],
                names=["anchor", "tid", "at", "places"],
            )
            for i in range(0, len(rows), cut)
        ]
        got = [(r["anchor"], r["tid"]) for b in suffixdedup._repeated(iter(batches)) for r in b.to_pylist()]
        assert got == [(2, 1), (2, 2), (2, 3), (5, 1), (5, 2)]


def brute_classes(rows, least=0.8, kind=Counter):
    """kind: Counter weighs a shingle by its count, set doesn't."""
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = kind(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else kind()

    def size(x):
        return sum(x.values()) if kind is Counter else len(x)

    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, ta in rows:
        for b, tb in rows:
            if a < b and ta is not None and tb is not None:
                both = size(sets[a] & sets[b])
                if ta == tb or both and both >= least * size(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


def test_near_duplicates(spark, docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)
    sets = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs, by_count=False).collect()}
    assert sets == brute_classes(texts, kind=set)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(got.values())


def test_near_duplicate_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "SENT_KEYS", 3)
    base = prose(50, 100).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 6):
            w[(7 * i + 13 * k) % 100] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows + rows[:2] + [(None, base[0])], "doc_id long, text string")
    found = neardup.near_duplicates(df).collect()
    got = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    assert got == brute_classes(rows) and len(found) == 63
    assert neardup.deduplicated(df).count() == len(set(got.values())) + 1


def test_weights_are_counts(spark):
    """A line repeated another number of times is the same set, but another multiset."""
    line = prose(70, 12) + " "
    rows = [(1, line * 20), (2, line * 5), (3, line * 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == brute_classes(rows)
    assert {r["class_id"] for r in neardup.near_duplicates(df, by_count=False).collect()} == {1}
    assert set(brute_classes(rows).values()) == {1, 2}


def test_rows_that_share_an_id_are_one_document(spark):
    w, z, v = prose(80, 90), prose(81, 90), prose(82, 50)
    rows = [(1, w), (1, z), (2, w + " x"), (3, z + " y"), (4, None), (4, v), (5, v), (1, None), (6, "!?"), (6, w + " q"), (7, None)]
    rows += [(None, w), (None, v + " n"), (None, prose(83, 40)), (None, prose(83, 40)), (None, prose(83, 40) + " z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = neardup.near_duplicates(df).collect()
    got = {(r["doc_id"], r["class_id"]) for r in found}
    assert len(found) == len(rows)
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 1), (7, 7), (None, 1), (None, 4), (None, None)}
    assert {r["doc_id"] for r in found if r["kept"]} == {1, 4, 7, None}
    kept = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(df).collect()]
    assert sorted((i, t or "") for i, t in kept if i is not None) == [(1, min(w, z)), (4, v), (7, "")]
    lone = [t for i, t in kept if i is None]
    assert len(lone) == 2 and None in lone and any(t and t.startswith(prose(83, 40)) for t in lone)


def test_no_documents(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.deduplicated(no_docs).count() == 0


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    hashes = common.mix64(np.arange(1, 61, dtype=np.uint64))
    a, b = rng.integers(0, 4, 60) + 0.5, rng.integers(0, 4, 60) + 0.5
    b[:30] = a[:30]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    t = 2048
    signed, filled = neardup.dart_signatures(
        np.concatenate([hashes, hashes]), np.repeat([0, 1], 60), 2, t, np.concatenate([a, b])
    )
    assert filled.all() and abs((signed[0] == signed[1]).mean() - want) < 0.05
    # Another horizon or another batch changes no signature.
    alone, _ = neardup.dart_signatures(hashes, np.zeros(60, int), 1, t, a)
    assert (alone[0] == signed[0]).all()
    none, filled = neardup.dart_signatures(hashes[:0], np.empty(0, int), 2)
    assert not filled.any()


def test_word_hashes_follow_the_words(texts):
    import pyarrow as pa

    hashes, _, _, bounds = common.words(*common.byte_view(pa.array([t for _, t in texts])))
    seen = {}
    for k, (_, t) in enumerate(texts):
        w = words(t)
        mine = hashes[bounds[k] : bounds[k + 1]].tolist()
        assert len(mine) == len(w)
        for x, h in zip(w, mine):
            assert seen.setdefault(h, x) == x
    assert len(set(seen.values())) == len(seen)
