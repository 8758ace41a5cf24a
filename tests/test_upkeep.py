"""Changes by buckets: a store after random edits equals one that was built whole, and small edits write little."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import blocks, graph, lexical
from tarn.plans import indexing
from tarn.sources import store
from tarn.streaming import ingest

NAMES = [f"step{c}Value" for c in "ABCDEFGH"]
TYPES = [f"Thing{c}" for c in "ABCDE"]


def _source(rng: random.Random) -> str:
    """A Python file of some classes and functions that name each other."""
    out = []
    for name in rng.sample(TYPES, rng.randrange(3)):
        out.append(f"class {name}({rng.choice(TYPES)}):\n    def {rng.choice(NAMES)}(self):\n        return {rng.choice(NAMES)}({rng.randrange(5)})\n")
    for name in rng.sample(NAMES, rng.randrange(1, 4)):
        out.append(f"def {name}(x):\n    return {rng.choice(NAMES)}(x) + {rng.choice(NAMES)}(x)\n")
    return "\n".join(out)


def _state(st: store.Store) -> dict:
    """All that an index holds, without times and job ids."""
    chunks = st.table("chunks")
    index = st.index()
    back = index.blocks.select("term", F.explode("postings").alias("p")).select("p.chunk_id", "term", "p.frequency", "p.doc_len")
    return {
        "documents": sorted(map(str, st.table("documents").select("document_id", "checksum", "chunk_count").collect())),
        "chunks": sorted(map(str, chunks.select("chunk_id", "document_id", "name").collect())),
        "postings": sorted(map(str, st.table("postings").collect())),
        "blocks": sorted(map(str, back.collect())),
        "statistics": tuple(blocks.corpus_figures(index.stats).first()),
        "edges": sorted(map(str, st.table("edges").select("edge_id", "from_chunk_id", "to_chunk_id", "resolved").collect())),
    }


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    rng = random.Random(8)
    for k in range(6):
        (root / f"m{k}.py").write_text(_source(rng))
    return root


def test_edits_write_little_and_equal_a_rebuild(spark, tree, tmp_path):
    rng = random.Random(9)
    st = store.Store(spark, str(tmp_path / "s"))
    for step in range(3):
        if step:
            for k in rng.sample(range(7), 2):
                (tree / f"m{k}.py").write_text(_source(rng))
            (tree / f"m{rng.randrange(7)}.py").unlink(missing_ok=True)
        before = {n: dict(v) for n, v in st.manifest["tables"].items()}
        job = indexing.index(st, str(tree), prune=True)
        assert job.status == "completed", job.message
        if step:
            same = [b for b, v in before["chunks"].items() if st.manifest["tables"]["chunks"].get(b) == v]
            assert same, "all buckets were written"
        # Edges as from all chunks at once.
        whole = graph.edges(st.table("chunks")).select("edge_id", "from_chunk_id", "to_chunk_id", "resolved")
        kept = st.table("edges").select(*whole.columns)
        assert sorted(map(str, whole.collect())) == sorted(map(str, kept.collect()))
    # One file changed: a bucket of each table, of the edges only if the file's bucket has any.
    before = {n: dict(v) for n, v in st.manifest["tables"].items()}
    file = sorted(tree.glob("*.py"))[0]
    file.write_text(file.read_text() + "\n\ndef unheardOf(x):\n    return 1\n")
    assert indexing.index(st, str(tree)).changed == 1
    for name in ("documents", "chunks", "postings", "blocks", "statistics", "edges"):
        now = st.manifest["tables"][name]
        changed = len([b for b, v in now.items() if before[name].get(b) != v])
        assert changed == 1 or (name == "edges" and not changed), name
    rebuilt = store.Store(spark, str(tmp_path / "r"), buckets=8)
    assert indexing.index(rebuilt, str(tree)).status == "completed"
    assert _state(st) == _state(rebuilt)
    plain = lexical.Index.of(st.table("postings"))
    assert tuple(plain.stats.first()) == pytest.approx(_state(st)["statistics"])


def test_names_that_gain_and_lose_owners(spark):
    columns = "chunk_id string, document_id string, chunk_type string, name string, content string"
    rows = [
        ("a", "1", "function", "alpha", "alpha() beta()"), ("b", "2", "function", "beta", "beta() gamma()"),
        ("c", "3", "function", "gamma", "gamma() alpha() gamma.delta"), ("d", "4", "function", "gamma", "twice"),
    ]
    old = spark.createDataFrame(rows, columns)
    new = spark.createDataFrame([("e", "4", "function", "delta", "delta() alpha()"), ("f", "4", "method", "X.alpha", "no")], columns)
    names = graph.changed_names(old.where("document_id <> '4'"), old.where("document_id = '4'"), new)
    # gamma gets its only owner, alpha loses it, delta is new.
    assert {(r["kind"], r["name"], r["to_id"]) for r in names.collect()} == {("call", "gamma", "c"), ("call", "alpha", None), ("call", "delta", "e")}


def test_stream_of_versions(spark, tmp_path):
    """A stream of edits and deletions ends as a batch of the last versions; a batch run again changes nothing."""
    rng = random.Random(4)
    first = [(f"/src/f{k}.py", _source(rng), 1) for k in range(3)] + [("/src/readme.md", "text", 1), ("/src/f0.py", _source(rng), 2)]
    second = [("/src/f1.py", _source(rng), 3), ("/src/f2.py", None, 4), ("/src/f3.py", _source(rng), 5), ("/src/f9.py", None, 6)]
    st = store.Store(spark, str(tmp_path / "s"), buckets=4)
    for rows in (first, second):
        spark.createDataFrame(rows, ingest.VERSIONS).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.keep(st, str(tmp_path / "in"), str(tmp_path / "mark")).awaitTermination()
    number = st.manifest["number"]
    ingest.take_in(st, spark.createDataFrame(second, ingest.VERSIONS), "again")
    assert st.manifest["number"] == number
    last = {}
    for path, text, _ in first + second:
        last[path] = text
    whole = store.Store(spark, str(tmp_path / "w"), buckets=4)
    ingest.take_in(whole, spark.createDataFrame([(p, t, 1) for p, t in last.items()], ingest.VERSIONS), "whole")
    assert _state(st) == _state(whole) and st.table("documents").count() == 3
