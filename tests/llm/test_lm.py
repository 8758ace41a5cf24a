import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import lm

TEXTS = ["The quick brown fox", "", "Jumps   over\tthe lazy dog's ÉTÉ\x0b", "the the the", " lead and trail ", "naïve space x" + "y" * 2500]


@pytest.fixture(scope="module")
def ranks():
    return lm.Subwords.read()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_and_subwords(ranks):
    words, sizes = lm.lower_words(pa.array([*TEXTS, None]))
    assert words.to_pylist() == [w for t in TEXTS for w in split(t)] and list(sizes) == [len(split(t)) for t in [*TEXTS, None]]
    sub = lm.Subwords(ranks)
    back = {i: t for t, i in ranks.items()}
    for some in (words.to_pylist(), [w for w in words.to_pylist() if len(w) < 99]):
        ids, at = sub.encode(pa.array(some))
        assert [b"".join(back[i] for i in ids[a:b]).decode() for a, b in zip(at, at[1:])] == [f" {w}" for w in some]
    assert sub.encode(pa.array(["", "a"]))[0][0] == sub.end and len(sub.encode(pa.array([], pa.string()))[0]) == 0


def model(seed=3):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(0, 900, 1500))[::-1]
    m = lm.CausalAttention.new(counts, end=5)
    for k, v in m.p.items():
        m.p[k] = (v + rng.normal(0, 0.3, v.shape)).astype(np.float32)
    return m, lm.Ids.of(counts)


def plain(m, stream, k, tail):
    """The log-probability of all next ids after stream[:k] of one text, key by key."""
    p = {n: v.astype(np.float64) for n, v in m.p.items()}
    x = p["E"][lm.embedding_rows(np.append(m.end, stream[:k]))]
    q, key, value = np.split(x @ p["QKV"], 3, axis=1)
    # Keys: from the block before the query's own on, by blocks of the whole stream, which starts with this text.
    low = max(0, (k // lm.BLOCK - 1) * lm.BLOCK)
    s = key[low : k + 1] @ q[k] * lm.WIDTH**-0.5 + p["far"][k - np.arange(low, k + 1)]
    a = np.exp(s) / np.exp(s).sum()
    h = np.maximum(np.append(x[k], a @ value[low : k + 1]) @ p["Wh"] + p["bh"], 0)
    outer = h @ p["W1"] + p["b1"]
    outer -= np.log(np.exp(outer).sum())
    parts = []
    for c in range(lm.CLASSES - 1):
        inner = h @ p["W2"][c] + p["b2"][c]
        parts.append(outer[c] + inner - np.log(np.exp(inner).sum()))
    return np.concatenate([*parts, outer[-1] + tail])


def test_scores_against_one_token_at_a_time():
    m, ids = model()
    rng = np.random.default_rng(5)
    stream = rng.integers(0, 1500, 90)
    got = m.score(stream, np.array([0]), ids.tail())
    for k in (0, 1, 15, 16, 17, 40, 89):
        want = plain(m, stream, k, ids.tail())
        assert abs(np.exp(want).sum() - 1) < 1e-9  # every id has its share
        assert abs(got[k] - want[stream[k]]) < 1e-3
    # Later tokens and other texts change nothing.
    other = np.append(stream[:48], rng.integers(0, 1500, 60))
    assert np.allclose(m.score(other, np.array([0, 48]), ids.tail())[:48], got[:48], atol=1e-4)
    alone = m.score(other[48:], np.array([0]), ids.tail())
    assert np.allclose(m.score(other, np.array([0, 48]), ids.tail())[48:], alone, atol=1e-4)


def test_long_streams_are_scored_in_pieces(monkeypatch):
    m, ids = model()
    stream = np.random.default_rng(6).integers(0, 1500, 1_000)
    first = np.array([0, 300, 301, 620])
    whole = m.score(stream, first, ids.tail())
    monkeypatch.setattr(lm, "AT_ONCE", 64)
    monkeypatch.setattr(lm, "CLASSED_AT_ONCE", 256)
    assert np.allclose(m.score(stream, first, ids.tail()), whole, atol=1e-4)


def test_gradient():
    m, _ = model()
    rng = np.random.default_rng(7)
    target = rng.integers(0, 1500, 50)
    first = np.array([0, 21])
    before = np.append(m.end, target[:-1])
    before[first] = m.end
    rows = np.append(np.zeros(lm.BLOCK, np.int64), lm.embedding_rows(before))
    start = np.repeat(first, [21, 29]) + lm.BLOCK
    weight = np.ones(50, np.float32)
    weight[:4] = 0

    def loss():
        return -(m.log_probabilities(m.hidden(rows, start)["h"], target, np.zeros(600)) * weight).sum() / weight.sum()

    g = m.gradient(rows, start, target, weight)
    for name, values in m.p.items():
        step = rng.normal(0, 1, values.shape).astype(np.float32)
        keep = values.copy()
        m.p[name] = keep + step * np.float32(1e-3)
        up = loss()
        m.p[name] = keep - step * np.float32(1e-3)
        down = loss()
        m.p[name] = keep
        assert abs((up - down) / 2e-3 - float((g[name] * step).sum())) < 0.03, name


def test_rows(spark, docs, texts, no_docs):
    rows = list(texts) + [(None, "river1 stone2"), (3, "river1 unseen"), (3, "river1 unseen")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, rare string").repartition(3)
    test = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    assert any(test)
    counts = Counter(w for (_, t), h in zip(rows, test) if not h for w in [*split(t), ""])
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (
            -1 if i is None else i, len(split(t)) + 1, sum(w in counts for w in [*split(t), ""]),
            round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in [*split(t), ""]), 6),
        )
        for i, t in rows
    )
    model = lm.learned(table.where(~lm.held_out()), rate=1, rounds=2)
    assert (model.tokens, model.kinds) == (total, kinds)
    for sent in (0, 40, 10**6):
        found = lm.scored(table, model, sent).collect()
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found)
        assert got == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    again = {r["doc_id"]: r["score"] for r in lm.scored(table, model).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-3 for r in found if r["doc_id"] not in (3, None))
    nothing = lm.learned(no_docs)
    assert (nothing.tokens, nothing.kinds) == (0, 0)
    assert lm.scored(no_docs, nothing).count() == 0 and lm.scored(table, nothing).count() == len(rows)


def test_learns_more_than_counts(spark):
    """Held-out texts of a fixed order of words are likelier to the model than by subword or word counts."""
    order = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(order[(i + k * (1 + i % 2)) % 10] for k in range(300))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.learned(docs.where(~lm.held_out()), rate=1, rounds=3)
    found = lm.scored(docs.where(lm.held_out()), model).collect()
    assert found and sum(r["score"] for r in found) > 0.6 * sum(r["base_score"] for r in found)


def test_learns_from_every_id_once(spark, ranks, monkeypatch):
    """the weights are trained on all windows of all training texts, not on a share of them."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(i * 67))) for i in range(30)] + [(None, None), (40, ""), (41, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []

    def trained(windows, ids, *more):
        seen.extend((r["lead"], np.frombuffer(r["ids"], np.uint16)) for r in windows.collect())
        return lm.CausalAttention.new(ids.counts, int(ids.rank[-1]))

    monkeypatch.setattr(lm, "trained", trained)
    model = lm.learned(docs)
    learned = np.concatenate([w[lead:] for lead, w in seen]).astype(np.int64)
    assert max(map(len, (w for _, w in seen))) < len(learned) / 9  # long texts come in several windows
    assert np.array_equal(np.bincount(learned, minlength=len(model.ids.counts)), model.ids.counts)


def test_windows_of_a_long_text_learn_what_the_whole_text_teaches(spark, ranks):
    """The context a window brings along is all that its ids look back on: losses equal those of the whole text."""
    text = " ".join(f"w{k * k % 97}" for k in range(900))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sub = lm.Subwords(ranks)
    whole = np.append(sub.encode(lm.lower_words(pa.array([text]))[0])[0], sub.end)
    ids = lm.Ids.of(np.bincount(whole, minlength=sub.end + 1))
    m = lm.CausalAttention.new(ids.counts, int(ids.rank[-1]))
    m.p["far"] = np.linspace(0, 1, 2 * lm.BLOCK).astype(np.float32)
    want = m.score(ids.rank[whole], np.array([0]), ids.tail())
    found = lm.training_windows(docs, spark.sparkContext.broadcast(ranks), ids.rank).collect()
    assert len(found) == -(-len(whole) // lm.WINDOW) > 2
    got = []
    for r in found:
        own = np.frombuffer(r["ids"], np.uint16).astype(np.int64)
        got.append(m.score(own, np.array([0]), ids.tail())[r["lead"] :])
    assert np.allclose(np.sort(np.concatenate(got)), np.sort(want), atol=1e-4)


def shuffled(spark):
    """Bytes of all shuffle files that this session has written and not yet removed."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data"))


def test_many_trainers_send_little(spark, monkeypatch):
    """what tasks send to be averaged is no more than their weights in 32 bits, however few windows each has."""
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 500)
    rng = np.random.default_rng(9)
    rows = [(k * 7919, 0, rng.integers(0, 3000, 500).astype(np.uint16).tobytes()) for k in range(40)]
    windows = spark.createDataFrame(rows, "place long, lead int, ids binary").repartition(4)
    ids = lm.Ids.of(np.sort(rng.integers(1, 900, 3000))[::-1])
    weights = len(lm.CausalAttention.new(ids.counts).flat())
    before = shuffled(spark)
    found = lm.trained(windows, ids, rounds=1)
    assert np.isfinite(found.flat()).all() and len(found.flat()) == weights
    assert shuffled(spark) - before < 40 * (4 * weights + 8_000)


def test_weights_are_averaged_by_tokens(spark, monkeypatch):
    """parts of weights that come from several tasks give the mean over all tasks."""
    monkeypatch.setattr(lm, "PART", 7)
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 100)
    rows = [(k, 0, np.full(100 + k, k, np.uint16).tobytes()) for k in range(12)]
    windows = spark.createDataFrame(rows, "place long, lead int, ids binary").repartition(5)
    ids = lm.Ids.of(np.arange(1200, 0, -1))
    start = {"a": np.arange(23, dtype=np.float32), "b": np.zeros((2, 3), np.float32)}

    class Told(lm.CausalAttention):
        @staticmethod
        def new(counts, end=0, seed=11):
            return Told({k: v.copy() for k, v in start.items()}, end)

        def fit(self, windows, rate):
            self.set(self.flat() + np.float32(sum(own[0] for _, own in windows)))
            return sum(len(own) for _, own in windows)

    monkeypatch.setattr(lm, "CausalAttention", Told)
    found = lm.trained(windows, ids, rounds=1)
    # As Spark deals the windows to the tasks.
    size = sum(100 + k for k in range(12))
    dealt = windows.repartition(max(1, round(size / 100)), "place").select("place", F.spark_partition_id().alias("task")).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault(r["task"], []).append(r["place"])
    assert len(tasks) > 2
    more = sum(sum(some) * sum(100 + k for k in some) for some in tasks.values()) / size
    assert np.allclose(found.flat(), np.concatenate([v.ravel() for v in start.values()]) + more, rtol=1e-5)
