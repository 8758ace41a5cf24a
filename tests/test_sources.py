"""Scanner, parsers, store, contexts, the indexing pipeline, tools and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tarn import cli
from tarn import schemas
from tarn.operators import blocks, graph, lookup
from tarn.plans import indexing, search, tools
from tarn.sources import files, store, symbols
from tarn.sources.contexts import ContextError, Contexts
from tarn.sources.embedding import HashingProvider, token_count
from tarn.streaming import ingest


def test_exclude_globs():
    assert files.exclude_regex("a.b") == r"a\.b"
    assert files.exclude_regex("*.ts") == r"[^/]*\.ts"
    assert files.exclude_regex("**/gen/*") == ".[^/]*/gen/[^/]*"
    assert files.exclude_regex("(") is None


def test_scan(spark, tmp_path):
    for name, text in {
        "a.ts": "export class A {}", "b.min.js": "x", "foo.bar.d.ts": "x", "foo.d.ts": "x", ".hidden.ts": "x",
        "empty.py": "", "big.java": "x" * 50, "x.data.json": "{}", "gen/c.ts": "x", "node_modules/d.ts": "x", "X.PY": "x", "__init__.py": "x",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    found = files.scan(spark, str(tmp_path), 40, ("/gen/",))
    got = {r["relative"]: (r["skip_reason"], r["language"]) for r in found.collect()}
    assert got == {
        "a.ts": (None, "typescript"), "b.min.js": ("ignored_extension", "javascript"),
        "foo.bar.d.ts": ("declaration_file", "typescript"), "foo.d.ts": ("ignored_extension", "typescript"),
        ".hidden.ts": ("hidden_file", "typescript"), "empty.py": ("empty_file", "python"),
        "big.java": ("too_large", "java"), "x.data.json": (None, None), "gen/c.ts": ("exclude_pattern", "typescript"),
        "node_modules/": ("ignored_directory", None), "X.PY": (None, None), "__init__.py": (None, "python"),
    }
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "missing"))
    summary = {r["reason"]: r["files"] for r in files.scan_summary(found).collect()}
    assert summary[None] == 4 and summary["too_large"] == 1
    assert files.scan_totals(found).first()[:] == (11, 7, 4)
    assert files.scan_totals(found.limit(0)).first()[:] == (0, 0, 0)


@pytest.mark.parametrize("wide", [1, 2, 5, 1000])
def test_listing_by_tasks(spark, tmp_path, wide):
    """However far the driver goes down itself, each file and pruned directory comes once."""
    want = {"dist/": None, "a/b/.x/": None}
    for name in ("r.py", "a/1.py", "a/b/2.py", "a/b/c/3.py", "a/b/c/d/4.py", "e/5.py", "e/f/6.py", "dist/7.py", "a/b/.x/8.py", "g/h/i/9.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
        if "dist" not in name and ".x" not in name:
            want[name] = len(name)
    (tmp_path / "bare" / "bare").mkdir(parents=True)
    rows = files.listed(spark, str(tmp_path), wide).collect()
    assert len(rows) == len(want) and {r["relative"]: r["size_bytes"] for r in rows} == want
    assert all(r["path"] == str(tmp_path / r["relative"]).rstrip("/") or r["size_bytes"] is None for r in rows)
    assert files.listed(spark, str(tmp_path / "bare"), wide).count() == 0
    assert files.listed(spark, str(tmp_path / "r.py"), wide).first()[:] == (str(tmp_path / "r.py"), "r.py", 4)


def test_classified_listing(spark):
    rows = [("/t/.git/a.py", ".git/a.py", 1), ("/t/x/dist/b.py", "x/dist/b.py", 1), ("/t/dist", "dist", 1), (None, None, 1), ("/t/a.py", "a.py", None)]
    found = files.classified(spark.createDataFrame(rows, "path string, relative string, size_bytes long"))
    assert [r["skip_reason"] for r in found.collect()] == ["ignored_directory", "ignored_directory", None, None, "ignored_directory"]


def test_older_layout(spark, tmp_path):
    """Stores of earlier layouts, one manifest and no buckets, are brought up to date in one commit."""
    root = tmp_path / "s"
    rows = [("c1", "alpha", 2, 3), ("c1", "beta", 1, 3), ("c2", "beta", 1, 1)]
    spark.createDataFrame(rows, "chunk_id string, term string, frequency long, doc_len long").drop("doc_len").write.parquet(f"{root}/old")
    (root / store.OLD_MANIFEST).write_text(json.dumps({"version": 1, "tables": {"postings": "old"}}))
    new = store.Store(spark, str(root))
    assert sorted(r[:] for r in new.table("postings").collect()) == rows
    again = store.Store(spark, str(root))
    assert again.manifest == new.manifest and again.manifest["version"] == 3
    assert [r["chunk_id"] for r in blocks.search(spark, again.index(), "beta").collect()] == ["c2", "c1"]
    other = tmp_path / "t"
    other.mkdir()
    (other / store.OLD_MANIFEST).write_text(json.dumps({"version": 9, "tables": {}}))
    with pytest.raises(ValueError):
        store.Store(spark, str(other))


def test_manifests(spark, tmp_path):
    """A crash while a manifest is written leaves the state before; of two writers of one number one fails."""
    st = store.Store(spark, str(tmp_path / "s"), buckets=4)
    rows = spark.createDataFrame([(f"d{i}", f"/p{i}") for i in range(9)], "document_id string, source_path string")
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.DOCUMENTS.fields])
    st.commit(documents=full)
    (tmp_path / "s" / (store.MANIFEST % 2)).write_text('{"version": 3, "num')
    again = store.Store(spark, st.path)
    assert again.manifest == st.manifest and again.table("documents").count() == 9
    with pytest.raises(store.Conflict):
        again.commit(documents=full)
    (tmp_path / "s" / (store.MANIFEST % 2)).unlink()
    (tmp_path / "s" / f".{store.MANIFEST % 2}.crc").unlink(missing_ok=True)
    # One bucket is replaced, the others keep their files.
    bucket = st.touched(full.where("document_id = 'd3'"))
    kept = st.table("documents", bucket).where("document_id <> 'd3'")
    again.commit(documents=(kept, bucket))
    assert sorted(r[0] for r in again.table("documents").select("document_id").collect()) == [f"d{i}" for i in range(9) if i != 3]
    changed = {b for b, v in st.manifest["tables"]["documents"].items() if again.manifest["tables"]["documents"].get(b) != v}
    assert changed <= {str(bucket[0])}
    with pytest.raises(store.Conflict):
        st.commit(documents=full)
    assert store.Store(spark, st.path).table("documents").count() == 8


TS = """import { E } from 'events'

/** Does things. */
export abstract class Base<T> extends E implements I<T>, J {
  private n = 1
  constructor(name: string) { super() }
  abstract gone(): void
  async run(x: number): Promise<void> { if (x) { y() } }
  _hidden() {}
}
export interface I<T> { a(): T }
export type Kind = 'a' | 'b'
enum No { A }
export const arrow = async (a: number) => { return a }
// adds
function add(a: number, b: number): number { return a + b }
"""
PY = '''import os
from typing import List

class A(Base, Generic[K]):
    """About A."""

    def __init__(self, x):
        def inner(): pass
        self.x = x

    @property
    def value(self) -> int:
        return self.x

    def _private(self): pass

    class Nested:
        def no(self): pass

if True:
    async def top(a, *, b=1):
        return a

def _kept():
    """Kept."""
'''
JAVA = """import java.util.List;
public class P extends Q implements R, S {
  private int n;
  public P() {}
  /** Runs. */
  public static int run(List<String> a, int b) { return 1; }
  private void no() {}
}
class Hidden { public void no() {} }
public enum Kind { A, B }
"""


def _named(language, text):
    found, imports = symbols.parse(language, text)
    return [(r["chunk_type"], r["name"]) for r in found], imports, {r["name"]: r for r in found}


def test_typescript():
    names, imports, by = _named("typescript", TS)
    assert imports == ["events"]
    assert names == [
        ("class", "Base"), ("method", "Base.constructor"), ("method", "Base.run"), ("interface", "I"), ("type", "Kind"),
        ("function", "arrow"), ("function", "add"),
    ]
    assert by["Base"]["metadata"]["extendsNames"] == ["E"] and by["Base"]["metadata"]["implementsNames"] == ["I", "J"]
    assert by["Base"]["metadata"]["docstring"] == "Does things." and by["add"]["metadata"]["docstring"] == "adds"
    assert "y()" not in by["Base"]["content"] and "private n = 1" in by["Base"]["content"]
    assert by["Base.run"]["metadata"]["isAsync"] and by["arrow"]["metadata"]["signature"] is None
    assert by["add"]["metadata"]["parameters"] == ["a", "b"] and by["add"]["start_line"] == 16


def test_python():
    names, imports, by = _named("python", PY)
    assert imports == ["os", "typing"]
    assert names == [("class", "A"), ("method", "A.value"), ("function", "top"), ("function", "_kept")]
    assert by["A"]["metadata"]["extendsNames"] == ["Base", "Generic[K]"]
    assert by["A.value"]["content"].lstrip().startswith("@property")
    assert by["_kept"]["metadata"]["docstring"] == "Kept." and by["top"]["metadata"]["isAsync"]


def test_java():
    names, imports, by = _named("java", JAVA)
    assert imports == ["java.util.List"]
    assert names == [("class", "P"), ("method", "P.run"), ("type", "Kind")]
    assert by["P"]["metadata"]["extendsNames"] == ["Q"] and by["P"]["metadata"]["implementsNames"] == ["R", "S"]
    assert by["P.run"]["metadata"]["parameters"] == ["a", "b"]


def test_contexts(tmp_path):
    contexts = Contexts(str(tmp_path))
    assert contexts.list() == [] and contexts.active() is None
    contexts.create("b")
    contexts.create("a", ("/x", "/x"))
    assert [c["name"] for c in contexts.list()] == ["a", "b"] and contexts.get("a")["paths"] == ["/x"]
    for bad in ("A", "", "a b"):
        with pytest.raises(ContextError):
            contexts.create(bad)
    with pytest.raises(ContextError):
        contexts.create("a")
    contexts.use("a")
    assert contexts.resolve()["name"] == "a" and contexts.resolve("b")["name"] == "b"
    contexts.add_path("a", "/y")
    contexts.remove_path("a", "/x")
    assert contexts.get("a")["paths"] == ["/y"]
    contexts.delete("a")
    with pytest.raises(ContextError):
        contexts.resolve()
    (tmp_path / "contexts.json").write_text("{broken")
    assert contexts.list() == []


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 3), (3, "d", 3)], "id int, name string, n int")
    got = sorted(map(tuple, store.upserted(old, new, "id", kept=("name",)).collect()))
    assert got == [(1, "a", 1), (2, "b", 9), (3, "d", 3)]
    documents = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "chunk_id string, document_id string")
    edges = spark.createDataFrame(
        [("c1", "c2", True), ("c2", "c1", True), ("c2", None, False)], "from_chunk_id string, to_chunk_id string, resolved boolean"
    )
    left = store.without_documents(
        {"documents": documents, "chunks": chunks, "edges": edges}, documents.where("document_id = 'd1'")
    )
    assert left["chunks"].count() == 1
    assert sorted(map(tuple, left["edges"].collect())) == [("c2", None, False), ("c2", None, False)]


def test_tokens_and_provider():
    assert token_count("a b  c") == 3 and token_count("") == 1
    a, b = HashingProvider(8).embed(["x y", "x y"])
    assert a == b and abs(sum(v * v for v in a) - 1) < 1e-9


def test_index_and_search(spark, tmp_path, monkeypatch):
    code = tmp_path / "code"
    code.mkdir()
    (code / "processor.ts").write_text(TS)
    (code / "service.ts").write_text("export class ServiceA {\n  go() { arrow(1) }\n}\nexport class ServiceB extends ServiceA { }\n")
    (code / "utils.py").write_text("def formatDate(d):\n    return d\n\ndef parseDate(d):\n    return formatDate(d)\n")
    (code / "none.py").write_text("x = 1\n")
    st = store.Store(spark, str(tmp_path / "store"))
    with pytest.raises(search.NotReady):
        search.search(st, "x", "bm25")
    job = indexing.index(st, str(code))
    assert (job.status, job.message, job.new, job.changed, job.unchanged) == ("completed", None, 4, 0, 0)
    assert st.table("documents").where("name = 'none.py'").first()["chunk_count"] == 0
    again = indexing.index(st, str(code))
    assert (again.new, again.changed, again.unchanged) == (0, 0, 4)
    (code / "utils.py").write_text("def formatDate(d):\n    return d + 1\n")
    (code / "none.py").unlink()
    changed = indexing.index(st, str(code))
    assert (changed.new, changed.changed, changed.unchanged) == (0, 1, 2)
    assert st.table("documents").count() == 4
    assert st.table("chunks").where("name = 'parseDate'").count() == 0
    pruned = indexing.index(st, str(code), prune=True)
    assert pruned.status == "completed" and st.table("documents").count() == 3
    assert indexing.index(st, str(tmp_path / "missing")).status == "failed"
    assert st.table("jobs").count() == 5
    edges = {(r["edge_type"], r["to_name"], r["resolved"]) for r in st.table("edges").collect()}
    assert ("extends", "ServiceA", True) in edges and ("calls", "arrow", True) in edges and ("extends", "E", False) in edges
    provider = HashingProvider(16)
    assert indexing.embed_pending(st, provider) == st.table("chunks").count()
    assert indexing.embed_pending(st, provider) == 0
    for strategy in ("bm25", "vector", "hybrid", "graph"):
        got = search.search(st, "ServiceB", strategy, 3, provider).collect()
        assert 0 < len(got) <= 3 and [r["rank"] for r in got] == list(range(1, len(got) + 1))
        assert strategy == "vector" or got[0]["name"] == "ServiceB"
    with pytest.raises(ValueError):
        search.search(st, "x", "other")
    assert "ServiceB" in tools.search_codebase(st, "ServiceB", "unknown")
    assert "class ServiceA" in tools.get_project_map(st) and "fn formatDate(d)" in tools.get_project_map(st)
    assert "formatDate" in tools.find_symbol(st, "format")
    assert f"{code}/utils.py:1-" in tools.find_symbol(st, "format")
    # Filters hold before the cut.
    for strategy in ("bm25", "graph"):
        got = search.search(st, "ServiceB formatDate", strategy, 1, language="python").collect()
        assert [r["name"] for r in got] == ["formatDate"]
        got = search.search(st, "ServiceB formatDate", strategy, 9, document_path=str(code / "service.ts")).collect()
        assert got and {r["source_path"] for r in got} == {str(code / "service.ts")}
    assert "ServiceB" in tools.call(st, "find_symbol", {"name": "ServiceB", "context": "demo"}, {"demo": st}.__getitem__)
    with pytest.raises(ValueError):
        tools.call(st, "find_symbol", {"name": "ServiceB", "context": "demo"})
    # A failure of the edge stage changes nothing; the next run does it all.
    before = dict(st.manifest["tables"])
    (code / "utils.py").write_text("def formatDate(d):\n    return d + 2\n")
    with monkeypatch.context() as broken:
        broken.setattr(graph, "edge_changes", lambda *chunks: 1 / 0)
        assert indexing.index(st, str(code)).status == "failed"
    assert {k: v for k, v in st.manifest["tables"].items() if k != "jobs"} == {k: v for k, v in before.items() if k != "jobs"}
    assert indexing.index(st, str(code)).changed == 1
    # Of two writers that began alike the second fails.
    other = store.Store(spark, st.path)
    st.commit(jobs=st.table("jobs"))
    with pytest.raises(store.Conflict):
        other.commit(jobs=other.table("jobs"))
    # A job that loses reports it and leaves its row; nothing is thrown.
    late = store.Store(spark, st.path)
    st.commit(jobs=st.table("jobs"))
    (code / "utils.py").write_text("def formatDate(d):\n    return d + 3\n")
    lost = indexing.index(late, str(code))
    assert lost.status == "failed" and "Conflict" in lost.message
    st.refresh()
    assert st.table("jobs").where(F.col("job_id") == lost.job_id).count() == 1
    assert indexing.index(st, str(code)).changed == 1
    assert "## class" in tools.get_file_context(st, str(code / "service.ts"))
    assert "not indexed" in tools.get_file_context(st, "/nowhere")
    one = st.table("documents").where("name = 'service.ts'").first()["document_id"]
    n = st.table("chunks").where(F.col("document_id") == one).count()
    assert n and indexing.embed_document(st, HashingProvider(8), one) == n
    assert st.table("embeddings").where("dimensions = 8").count() == n
    assert indexing.embed_document(st, HashingProvider(8), "nothing") == 0
    totals = indexing.statistics(spark, st)
    assert totals["totals"].first()["documents"] == 3 and totals["size_bytes"] > 0
    monkeypatch.setenv("TARN_DATA_DIR", str(tmp_path / "data"))
    assert cli.main(["context", "create", "demo"]) == "created demo"
    cli.main(["context", "use", "demo"])
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert "3 new" in cli.main(["index", str(code)])
    assert "ServiceB" in cli.main(["search", "ServiceB", "--strategy", "bm25"])
    assert "formatDate" in cli.main(["search", "ServiceB formatDate", "--strategy", "bm25", "--language", "python"])
    assert "formatDate" not in cli.main(["search", "ServiceB formatDate", "--strategy", "bm25", "--type", "class"])
    status = cli.main(["status"])
    assert status.startswith("3 documents") and "python" in status and "class" in status


def test_lookup_order(spark):
    chunks = spark.createDataFrame(
        [("1", "d", "b", "method", 2), ("2", "d", "a", "class", 9), ("3", "d", "c", "enum", 1)],
        "chunk_id string, document_id string, name string, chunk_type string, start_line int",
    )
    assert [r["name"] for r in lookup.file_context(chunks, "d").collect()] == ["a", "b"]
    assert [r["name"] for r in lookup.find_symbol(chunks, "_").collect()] == ["a", "b", "c"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (2, "gamma")], "chunk_id long, content string")
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows.write.parquet(source)
    ingest.follow(spark, source, rows.schema, target, mark).awaitTermination()
    got = {(r["chunk_id"], r["term"], r["frequency"]) for r in spark.read.parquet(target).collect()}
    assert got == {(1, "alpha", 2), (1, "beta", 1), (2, "gamma", 1)}
    rows.where("chunk_id = 2").withColumn("chunk_id", F.lit(3).cast("long")).write.mode("append").parquet(source)
    ingest.follow(spark, source, rows.schema, target, mark).awaitTermination()
    assert spark.read.parquet(target).count() == 4
