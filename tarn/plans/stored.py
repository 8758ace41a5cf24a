"""Registered queries of the stored index and its upkeep, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import blocks, graph, lexical
from tarn.plans import tables
from tarn.plans.oracles import _DF, _DL, _G, _GE, _P, _RANKED, _ST, _bm25, _one
from tarn.plans.registered import LIMIT, QUERY, _queries, _ranked
from tarn.sources.scratch import written

BUCKETS = 16


def _postings(spark, d) -> DataFrame:
    found = lexical.postings(tables.chunks(spark, d), once=True)
    return found.withColumn("bucket", blocks.bucket_of(F.col("chunk_id"), BUCKETS))


def stored_search(spark, d):
    """The keyword query over stored blocks of postings, of which few are read."""
    index = blocks.BlockIndex.of(_postings(spark, d))
    return _ranked(blocks.search_batch(index, _queries(spark, QUERY), LIMIT))


def stored_batch(spark, d):
    """Every benchmark text as a query over stored blocks."""
    asked = tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _ranked(blocks.search_batch(blocks.BlockIndex.of(_postings(spark, d)), asked, LIMIT))


def stored_blocks(spark, d):
    """Of every term: its postings, its occurrences and its greatest frequency, from the blocks."""
    found = blocks.blocks(written(_postings(spark, d), "postings"))
    times = F.aggregate("postings", F.lit(0).cast("long"), lambda s, p: s + p["frequency"])
    return found.groupBy("term").agg(F.sum("n").alias("df"), F.sum(times).alias("frequency"), F.max("most").alias("most"))


def stored_stats(spark, d):
    """Chunks and average length from the buckets' statistics, those of the French chunks' buckets made again."""
    postings = written(_postings(spark, d), "postings")
    stats = blocks.statistics(postings)
    french = tables.chunks(spark, d).where("language = 'fr'").select(blocks.bucket_of(F.col("chunk_id"), BUCKETS).alias("bucket")).distinct()
    again = blocks.statistics(postings.join(F.broadcast(french), "bucket", "left_semi"))
    found = blocks.corpus_figures(stats.join(french, "bucket", "left_anti").unionByName(again))
    return found.select("n", F.round("avgdl", 6).alias("avgdl"))


def edge_deletion(spark, d):
    """The edges after one file's deletion, by what it changes: equal to those of the files that are left."""
    chunks = tables.graph_chunks(spark, d)
    gone = F.col("document_id") == "2"
    stored = written(graph.edges(chunks), "edges")
    found = graph.updated_edges(stored, chunks.where(~gone), chunks.where(gone), chunks.limit(0))
    return found.select("from_chunk_id", "to_chunk_id", "to_name", "edge_type", "weight", "resolved")


def edge_arrival(spark, d):
    """The edges after one file's arrival: equal to those of all files."""
    chunks = tables.graph_chunks(spark, d)
    new = F.col("document_id") == "3"
    stored = written(graph.edges(chunks.where(~new)), "edges")
    found = graph.updated_edges(stored, chunks.where(~new), chunks.limit(0), chunks.where(new))
    return found.select("from_chunk_id", "to_chunk_id", "to_name", "edge_type", "weight", "resolved")


QUERIES = {f.__name__: f for f in (stored_search, stored_batch, stored_blocks, stored_stats, edge_deletion, edge_arrival)}

_LEFT = _G.replace("g AS (", "g_all AS (", 1) + ", g AS (SELECT * FROM g_all WHERE document_id <> '2')"
_EDGES = "SELECT from_chunk_id, to_chunk_id, to_name, edge_type, weight, resolved FROM ge"
_BENCHMARK = "(SELECT item_id AS query_id, text FROM benchmark)"
ORACLES = {
    "stored_search": f"WITH {_P}, {_DL}, {_ST}, {_DF}, {_bm25(_one(QUERY), LIMIT)} {_RANKED} FROM bm",
    "stored_batch": f"WITH {_P}, {_DL}, {_ST}, {_DF}, {_bm25(_BENCHMARK, LIMIT)} {_RANKED} FROM bm",
    "stored_blocks": f"""WITH {_P} SELECT term, count(*) AS df, CAST(sum(frequency) AS BIGINT) AS frequency, max(frequency) AS most
        FROM p GROUP BY term""",
    "stored_stats": f"WITH {_P}, {_DL}, {_ST} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "edge_deletion": f"WITH {_LEFT}, {_GE} {_EDGES}",
    "edge_arrival": f"WITH {_G}, {_GE} {_EDGES}",
}
