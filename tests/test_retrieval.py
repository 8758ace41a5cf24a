"""Tokeniser, BM25, vectors, fusion and graph on small fixtures."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tarn.functions import scalars
from tarn.functions.scalars import name_tier, type_multiplier
from tarn.functions.tokenize import emitted, terms
from tarn.operators import graph, hybrid, lexical, vector
from tarn.schemas import METADATA


def _terms(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", terms(F.col("t"))).orderBy("i").collect()]


def test_terms(spark):
    got = _terms(
        spark, "parseResult", "TypeScriptParser", "BM25Retriever", "search search search", "123 456 0 99", "a b c",
        "const let var", "a" * 50, "a" * 51, "foo_bar indexer", None, "",
    )
    assert got[0] == ["parse", "result", "parseresult", "parseresult"]
    assert got[1] == ["script", "parser", "typescript", "scriptparser", "typescriptparser"]
    assert got[2] == ["bm25", "retriever", "bm25retriever", "bm25retriever"]
    assert got[3] == ["search"] * 3
    assert got[4] == got[5] == got[6] == got[8] == got[10] == got[11] == []
    assert got[7] == ["a" * 50]
    assert got[9] == ["foo_bar", "indexer"]


def test_emitted_keeps_whole_token_once(spark):
    row = spark.createDataFrame([("a1B",)], "t string").select(emitted(F.col("t"))).first()[0]
    assert row == ["a1", "b", "a1b", "a1b"]


CORPUS = [
    ("chunk-tokenizer", "CodeTokenizer splits camelCase tokens and filters stop words for BM25 indexing"),
    ("chunk-edge", "EdgeBuilder creates graph edges between class chunks resolving extends and implements relationships"),
    ("chunk-indexer", "CodebaseIndexer orchestrates three phase indexing scanning parsing and embedding"),
]


@pytest.fixture(scope="module")
def index(spark):
    return lexical.Index.build(spark.createDataFrame(CORPUS, "chunk_id string, content string"))


def test_lengths_and_stats(index):
    lengths = {r[0]: r[1] for r in lexical.doc_lengths(index.postings).collect()}
    assert lengths == {"chunk-tokenizer": 14, "chunk-edge": 11, "chunk-indexer": 11}
    assert tuple(index.stats.first()) == (3, 12.0)


@pytest.mark.parametrize(
    "query, expected",
    [
        ("tokenizer", [("chunk-tokenizer", 0.9123993051)]),
        ("graph edges", [("chunk-edge", 2.0380867595)]),
        ("indexing phases", [("chunk-indexer", 0.4883154590), ("chunk-tokenizer", 0.4372126784)]),
        ("indexing tokens", [("chunk-tokenizer", 1.3496119835), ("chunk-indexer", 0.4883154590)]),
        ("xyzzy", []),
        ("the and", []),
    ],
)
def test_bm25(spark, index, query, expected):
    got = [(r["chunk_id"], r["score"], r["rank"]) for r in lexical.search(spark, index, query).orderBy("rank").collect()]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[2] for g in got] == list(range(1, len(got) + 1))
    for g, e in zip(got, expected):
        assert math.isclose(g[1], e[1] / expected[0][1], rel_tol=1e-8)


def test_bm25_batch_and_limit(spark, index):
    asked = spark.createDataFrame([(1, "indexing"), (2, "edges"), (3, "")], "query_id long, text string")
    got = lexical.search_batch(index, asked, 1).collect()
    assert sorted(r["query_id"] for r in got) == [1, 2]


def test_vectors(spark, monkeypatch):
    stored = spark.createDataFrame(
        [("a", [1.0, 0.0, 0.0]), ("b", [0.7, 0.7, 0.0]), ("c", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("s", [1.0])],
        "chunk_id string, embedding array<float>",
    )
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, vector array<float>")
    got = [(r["chunk_id"], round(r["score"], 4)) for r in vector.search_batch(stored, asked).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 0.7071), ("c", 0.0), ("s", 0.0), ("z", 0.0)]
    assert vector.check_ready(stored.limit(1), 3)
    assert not vector.check_ready(stored.limit(0), 3)
    with pytest.raises(vector.DimensionMismatch):
        vector.check_ready(stored.limit(1), 4)
    twice = asked.unionByName(asked.withColumn("query_id", F.lit(5).cast("long")))
    monkeypatch.setattr(vector, "BLOCK_VALUES", 3)
    assert vector.search_batch(stored, twice, 2).count() == 4
    assert vector.search_batch(stored, asked.limit(0)).count() == 0
    assert vector.search_batch(stored.limit(0), asked).count() == 0


def test_vectors_in_slices(spark, monkeypatch):
    """Queries stay off the driver, products stay small, and ties go by chunk_id over all slices."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 4)).astype(float)
    ids = [f"c{i}" for i in rng.permutation(300)]
    stored = spark.createDataFrame(list(zip(ids, x.tolist())), "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "query_id long, vector array<float>")
    for name, value in (("BLOCK_VALUES", 60), ("TASK_VALUES", 200), ("CELLS", 200), ("ROWS", 16)):
        monkeypatch.setattr(vector, name, value)
    fetch = type(asked).collect

    def few(self):
        rows = fetch(self)
        assert len(rows) < 2, "queries were fetched"
        return rows

    with monkeypatch.context() as m:
        m.setattr(type(asked), "collect", few)
        found = vector.search_batch(stored, asked, 7)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in found.collect()}
    size = np.sqrt((x**2).sum(axis=1))
    scale = size[:, None] * size[None, :]
    cosine = np.round(np.divide(x @ x.T, scale, out=np.zeros_like(scale), where=scale > 0), 9)
    for i in range(40):
        want = sorted(range(300), key=lambda j: (-cosine[i, j], ids[j]))[:7]
        assert [got[i, r + 1] for r in range(7)] == [ids[j] for j in want]


def _list(spark, ids):
    rows = [(0, c, 1.0, i + 1) for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank int")


def test_hybrid(spark):
    a, b = _list(spark, ["x", "both"]), _list(spark, ["both", "y"])
    names = spark.createDataFrame([(c, c) for c in ("x", "y", "both")], "chunk_id string, name string")
    asked = spark.createDataFrame([(0, "nothing here")], "query_id long, text string")
    got = hybrid.search_batch(a, b, names, asked, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["both", "x", "y"] and got[0]["score"] == 1.0
    # A lexical-only hit and a vector-only hit of one rank tie; the lexical one comes first.
    tie = hybrid.search_batch(_list(spark, ["x"]), _list(spark, ["y"]), names, asked, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in tie] == ["x", "y"]
    boosted = hybrid.search_batch(
        _list(spark, ["x"]), _list(spark, ["y"]),
        spark.createDataFrame([("x", "Other"), ("y", "IndexerService")], "chunk_id string, name string"),
        spark.createDataFrame([(0, "indexer service")], "query_id long, text string"), 2,
    ).collect()
    assert all(r["score"] <= 1.0 for r in boosted)
    zero = hybrid.fused(_list(spark, []), _list(spark, ["y"]), 1.0).first()
    assert zero["score"] == 0.0


def test_scalars(spark):
    df = spark.createDataFrame([("Foo", "foo"), ("Foobar", "foo"), ("aFoo", "foo")], "n string, t string")
    assert [r[0] for r in df.select(name_tier(F.col("n"), F.col("t"))).collect()] == [1.0, 0.9, 0.75]
    df = spark.createDataFrame([("method", "A.constructor"), ("enum", "E"), ("odd", "x")], "k string, n string")
    assert [r[0] for r in df.select(type_multiplier(F.col("k"), F.col("n"))).collect()] == [0.2, 0.5, 1.0]


def _chunk(cid, name, kind, content="", doc="d1", **meta):
    m = tuple(meta.get(f.name) for f in METADATA.fields)
    return (cid, doc, name, kind, content or name, m)


def _chunks(spark, rows):
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("chunk_id", "document_id", "name", "chunk_type", "content")]
        + [T.StructField("metadata", METADATA)]
    )
    return spark.createDataFrame(rows, schema)


def test_edges(spark):
    rows = [
        _chunk("A", "A", "class", extendsNames=["Base", "Gone", "Twice"]),
        _chunk("Base", "Base", "class", doc="d2"),
        _chunk("T1", "Twice", "class"),
        _chunk("T2", "Twice", "class", doc="d2"),
        _chunk("m", "A.parseResult", "method", "return helperFn(1) + parseResult()", parentName="A"),
        _chunk("f", "helperFn", "function", "parseResultData(x)"),
        _chunk("g", "abc", "function", "helperFn.abc"),
        _chunk("w", "$x.we$ird", "function", "call abc"),
        _chunk("u", "user", "function", "see we$ird(2) and $we$ird2"),
    ]
    got = {(r["edge_type"], r["from_chunk_id"], r["to_chunk_id"], r["to_name"]) for r in graph.edges(_chunks(spark, rows)).collect()}
    assert got == {
        ("contains", "A", "m", "A.parseResult"),
        ("extends", "A", "Base", "Base"),
        ("extends", "A", None, "Gone"),
        ("extends", "A", None, "Twice"),
        ("calls", "m", "f", "helperFn"),
        ("calls", "g", "f", "helperFn"),
        ("calls", "u", "w", "we$ird"),
    }


def test_graph_search_names(spark):
    rows = [
        _chunk("1", "BM25Retriever", "class"),
        _chunk("2", "BM25Retriever.search", "method", parentName="BM25Retriever"),
        _chunk("3", "EdgeBuilder", "class"),
    ]
    chunks = _chunks(spark, rows)
    asked = spark.createDataFrame([(0, "BM25Retriever")], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, chunk_id string, score double, rank int")
    seeds = graph.all_seeds(graph.name_seeds(chunks, asked), none)
    got = graph.search_batch(chunks, graph.edges(chunks), seeds).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["1", "2"] and got[0]["score"] == 1.0


def _fifo(seeds, links, far=2):
    """The queue as it would run: a node expands once, with the score it was first queued with."""
    best, queue, seen = {}, deque(), set()
    for node, score in seeds:
        best[node] = max(best.get(node, 0), score)
        queue.append((node, score, far))
    while queue:
        node, score, hops = queue.popleft()
        if node in seen or hops == 0:
            continue
        seen.add(node)
        for there, weight in links.get(node, []):
            s = score * weight * graph.DECAY
            best[there] = max(best.get(there, 0), s)
            queue.append((there, s, hops - 1))
    return best


@pytest.mark.parametrize("seed, hops", [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1), (5, 3), (6, 4)])
def test_expansion_is_the_queue(spark, seed, hops):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = {(rng.choice(nodes), rng.choice(nodes), rng.choice(list(graph.WEIGHTS))) for _ in range(26)}
    edges = [(a, b, k) for a, b, k in edges if a != b]
    order = list(graph.WEIGHTS)
    ranked = sorted(edges, key=lambda e: (order.index(e[2]) + 1, e[0], e[1], e[1]))
    links = {}
    for a, b, k in ranked:
        links.setdefault(a, []).append((b, graph.WEIGHTS[k]))
    for a, b, k in ranked:
        links.setdefault(b, []).append((a, graph.WEIGHTS[k]))
    seeds = [(n, round(rng.uniform(0.3, 1), 3)) for n in rng.sample(nodes, 3)]
    df = spark.createDataFrame(
        [(a, b, b, k, graph.WEIGHTS[k], True) for a, b, k in edges],
        "from_chunk_id string, to_chunk_id string, to_name string, edge_type string, weight double, resolved boolean",
    )
    start = spark.createDataFrame(
        [(0, n, s, i) for i, (n, s) in enumerate(seeds)], "query_id long, chunk_id string, score double, seed long"
    )
    got = {r["chunk_id"]: round(r["score"], 9) for r in graph.expanded(start, df, hops=hops).collect()}
    assert got == {k: round(v, 9) for k, v in _fifo(seeds, links, hops).items()}


def test_readiness(spark):
    postings = spark.createDataFrame([("a", "x")], "chunk_id string, term string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    edges = spark.createDataFrame([("a", False)], "from_chunk_id string, resolved boolean")

    def got(*tables):
        return {r["strategy"]: r["ready"] for r in vector.readiness(*tables, 2).collect()}

    assert got(postings, vectors, edges) == {"bm25": True, "vector": True, "hybrid": True, "graph": False}
    assert got(postings.limit(0), vectors, edges.withColumn("resolved", F.lit(True))) == {
        "bm25": False, "vector": True, "hybrid": False, "graph": True,
    }
    other = vectors.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    assert not got(postings, other, edges)["vector"] and not got(postings, vectors.limit(0), edges)["hybrid"]


def test_figures(spark):
    def shown(column, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
        return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]

    assert shown(scalars.readable_bytes, 0.0, 1023.0, 1024.0, 1280.0, 1048576.0, 3.5 * 1024**3, None) == [
        "0 B", "1023 B", "1.0 KB", "1.3 KB", "1.0 MB", "3.5 GB", None,
    ]
    assert shown(scalars.readable_duration, 0.0, 999.4, 1000.0, 59_900.0, 60_000.0, 125_400.0, None) == [
        "0ms", "999ms", "1.0s", "59.9s", "1m 0s", "2m 5s", None,
    ]
    rows = spark.createDataFrame([(0, 0), (1, 200), (1, 3), (9, 3)], "a int, b int")
    assert [r[0] for r in rows.select(scalars.percent(F.col("a"), F.col("b"))).collect()] == [0, 1, 33, 100]
