"""Search over a store by strategy, and the markdown that tools return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import blocks, graph, hybrid, lexical, lookup, vector
from tarn.schemas import STRATEGIES
from tarn.sources.embedding import Provider
from tarn.sources.store import Store


class NotReady(RuntimeError):
    """The index that a strategy needs isn't there yet."""


def search(
    store: Store, query: str, strategy: str = "graph", limit: int = 10, provider: Provider | None = None,
    weight: float = 0.5, language: str | None = None, chunk_type: str | None = None, document_path: str | None = None,
) -> DataFrame:
    """Result rows of one query text; the strategies are bm25, vector, hybrid and graph.

    The filters hold before any cut, so ``limit`` rows come back if so many match.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    spark = store.spark
    queries = spark.createDataFrame([(0, query)], "query_id long, text string")
    chunks, among = store.table("chunks"), None
    if (language, chunk_type, document_path) != (None, None, None):
        among = lookup.filtered(chunks, language, chunk_type)
        if document_path is not None:
            of = store.table("documents").where(F.col("source_path") == document_path)
            among = among.join(of.select("document_id"), "document_id", "left_semi")
        among = among.select("chunk_id")

    def lexical_rows(n: int, among: DataFrame | None = among) -> DataFrame:
        if not lexical.is_ready(store.table("postings")):
            raise NotReady("no postings; index first")
        return blocks.search_batch(store.index(), queries, n, among)

    def vector_rows(n: int) -> DataFrame:
        if provider is None or not vector.check_ready(store.table("embeddings"), provider.dimensions):
            raise NotReady("no vectors; embed first")
        asked = spark.createDataFrame([(0, provider.embed([query])[0])], "query_id long, vector array<float>")
        stored = store.table("embeddings")
        return vector.search_batch(stored if among is None else stored.join(among, "chunk_id", "left_semi"), asked, n)

    if strategy == "bm25":
        ranked = lexical_rows(limit)
    elif strategy == "vector":
        ranked = vector_rows(limit)
    elif strategy == "hybrid":
        n = hybrid.over_fetch(limit)
        ranked = hybrid.search_batch(lexical_rows(n), vector_rows(n), chunks, queries, limit, weight)
    else:
        edges = store.table("edges")
        if not graph.is_ready(edges):
            raise NotReady("no edges; index first")
        seeds = graph.all_seeds(graph.name_seeds(chunks, queries), lexical_rows(graph.SEEDS, None))
        ranked = graph.search_batch(chunks, edges, seeds, limit, among, n_queries=1)
    return lookup.hydrated(ranked, chunks, store.table("documents"), strategy, limit).orderBy("rank")


def markdown(results: DataFrame, lines: int = 8) -> str:
    """The rows of one search, at most its limit, as text."""
    out = []
    for r in results.collect():
        code = "\n".join(r["content"].split("\n")[:lines])
        out.append(
            f"### {r['rank']}. {r['name']} ({r['chunk_type']}, {r['score']:.3f})\n"
            f"{r['source_path']}:{r['start_line']}-{r['end_line']}\n```{r['language']}\n{code}\n```"
        )
    return "\n\n".join(out) if out else "No results."


def symbol_markdown(found: DataFrame, lines: int = 6) -> str:
    out = []
    for r in found.collect():
        code = "\n".join(r["content"].split("\n")[:lines])
        more = [f"{label}: {r['metadata'][field]}" for label, field in (("signature", "signature"), ("parent", "parentName")) if r["metadata"] and r["metadata"][field]]
        place = f"{r['source_path']}:{r['start_line']}-{r['end_line']}"
        out.append("\n".join([f"### {r['name']} ({r['chunk_type']})", place, *more, f"```{r['language']}\n{code}\n```"]))
    return "\n\n".join(out) if out else "No symbols."


def file_markdown(found: DataFrame, path: str, lines: int = 10) -> str:
    out, last = [f"# {path}"], None
    for r in found.collect():
        if r["chunk_type"] != last:
            last = r["chunk_type"]
            out.append(f"## {last}")
        code = "\n".join(r["content"].split("\n")[:lines])
        out.append(f"### {r['name']} ({r['start_line']}-{r['end_line']})\n```{r['language']}\n{code}\n```")
    return "\n\n".join(out)
