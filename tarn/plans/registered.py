"""The registered queries of the core engine, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import scalars
from tarn.functions.tokenize import camel_parts, emitted, terms, tokens
from tarn.operators import graph, hybrid, lexical, lookup, names, vector
from tarn.plans import tables
from tarn.sources import files, store
from tarn.sources.scratch import written

QUERY = "Apache License thing Version onble"
SYMBOL_QUERY = "NATION_7 asia Supplier"
LIMIT = 10


def _queries(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def _ranked(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    return df.select("query_id", key, F.round("score", 6).alias("score"), "rank")


def tokenize_terms(spark, d):
    return lexical.postings(tables.chunks(spark, d)).select("chunk_id", "term", "frequency")


def camel_split(spark, d):
    found = tables.chunks(spark, d).select(F.explode(tokens(F.col("content"))).alias("token"))
    parts = camel_parts(F.col("token"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", F.array_join(parts, " ").alias("parts"), "n")


def emitted_terms(spark, d):
    found = tables.chunks(spark, d).select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")).distinct()
    return found.select("token", F.array_join(emitted(F.col("token")), ",").alias("emitted"))


def term_frequencies(spark, d):
    found = lexical.postings(tables.chunks(spark, d))
    return found.groupBy("term").agg(F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("df"))


def doc_lengths(spark, d):
    return lexical.lengths(tables.chunks(spark, d))


def corpus_stats(spark, d):
    found = lexical.corpus_stats(lexical.lengths(tables.chunks(spark, d)))
    return found.select("n", F.round("avgdl", 6).alias("avgdl"))


def document_frequency(spark, d):
    return lexical.Index.build(tables.chunks(spark, d)).frequencies


def idf(spark, d):
    index = lexical.Index.build(tables.chunks(spark, d))
    found = index.frequencies.join(F.broadcast(index.stats), F.lit(True))
    return found.select("term", F.round(scalars.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_search(spark, d):
    return _ranked(lexical.search(spark, lexical.Index.build(tables.chunks(spark, d)), QUERY, LIMIT))


def bm25_batch(spark, d):
    asked = tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _ranked(lexical.search_batch(lexical.Index.build(tables.chunks(spark, d)), asked, LIMIT))


def bm25_conversations(spark, d):
    turns = tables.read(spark, d, "conversations")
    rows = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content"))
    return _ranked(lexical.search(spark, lexical.Index.build(rows), QUERY, LIMIT))


def filtered_search(spark, d):
    """Keyword search among German chunks only: the filter comes before the cut."""
    chunks = tables.chunks(spark, d)
    among = lookup.filtered(chunks, language="de").select("chunk_id")
    return _ranked(lexical.search_batch(lexical.Index.build(chunks), _queries(spark, QUERY), LIMIT, among))


def hydrate_chunks(spark, d):
    chunks = tables.chunks(spark, d)
    ranked = lexical.search(spark, lexical.Index.build(chunks), QUERY, LIMIT)
    wide = chunks.join(F.broadcast(ranked), "chunk_id").join(tables.documents(spark, d), "document_id")
    return wide.select(
        "chunk_id", "document_id", "name", "chunk_type", "language", "chunk_count", F.round("score", 6).alias("score"),
        "rank", F.lit("bm25").alias("strategy"), F.sha2("content", 256).alias("content_sha"),
    )


def name_match(spark, d):
    chunks = tables.chunks(spark, d)
    asked = _queries(spark, "thing", "on", "eau")
    found = names.matches(chunks, asked.withColumnRenamed("text", "token")).withColumnRenamed("token", "text")
    hits = chunks.select("chunk_id", "name").join(found, "name")
    out = lookup.ranked_within(hits, "query_id", F.length("name"), "chunk_id").where("rank <= 20")
    return out.select("query_id", "chunk_id", "name", scalars.name_tier(F.col("name"), F.col("text")).alias("tier"), "rank")


def find_symbol(spark, d):
    files = tables.documents(spark, d).withColumn("source_path", F.concat(F.lit("/"), "document_id"))
    found = lookup.find_symbol(tables.chunks(spark, d), "the", documents=files)
    return found.select("chunk_id", "name", "chunk_type", "source_path")


def find_symbol_typed(spark, d):
    return lookup.find_symbol(tables.chunks(spark, d), "t_", "class").select("chunk_id", "name", "chunk_type")


def part_names(spark, d):
    parts = tables.read(spark, d, "part").select(
        F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("name"), F.col("p_type").alias("chunk_type")
    )
    return lookup.find_symbol(parts, "RING").select("chunk_id", "name", "chunk_type")


def file_context(spark, d):
    found = lookup.file_context(tables.chunks(spark, d), "src3")
    return found.select("chunk_id", "name", "chunk_type", "type_order", scalars.preview(F.col("content"), 2).alias("preview"))


def chunks_of_document(spark, d):
    return lookup.chunks_of(tables.chunks(spark, d), "src1").select("chunk_id", "name", "language")


def point_lookup(spark, d):
    return tables.chunks(spark, d).where(F.col("chunk_id") == 7).select("chunk_id", "document_id", "name")


def documents_listing(spark, d):
    return lookup.newest_documents(tables.documents(spark, d))


def stats_totals(spark, d):
    return lookup.stats_totals(tables.documents(spark, d))


def stats_by_language(spark, d):
    return lookup.counts_by(tables.chunks(spark, d), "language")


def stats_by_type(spark, d):
    return lookup.counts_by(tables.chunks(spark, d), "chunk_type")


def stats_last_indexed(spark, d):
    events = tables.read(spark, d, "events")
    return events.agg(F.max("ts").alias("last_indexed"))


def json_metadata(spark, d):
    events = tables.read(spark, d, "events")
    value = F.get_json_object("props", "$.k").cast("long")
    return events.where(value.isNotNull()).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def stats_postings(spark, d):
    found = lexical.postings(tables.chunks(spark, d))
    return found.agg(F.count(F.lit(1)).alias("postings"), F.sum("frequency").alias("frequency"))


def vector_search(spark, d):
    stored = tables.embeddings(spark, d)
    asked = stored.where("chunk_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return _ranked(vector.search_batch(stored, asked, LIMIT))


def vector_batch(spark, d):
    stored = tables.embeddings(spark, d)
    asked = stored.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _ranked(vector.search_batch(stored, asked, LIMIT))


def embedding_dims(spark, d):
    return tables.embeddings(spark, d).groupBy(F.size("embedding").alias("dimensions")).agg(F.count(F.lit(1)).alias("n"))


def unembedded(spark, d):
    chunks = tables.chunks(spark, d).withColumn("created_at", F.col("chunk_id"))
    return vector.pending(chunks, tables.embeddings(spark, d)).select("chunk_id", "name")


def with_embedding(spark, d):
    found = tables.chunks(spark, d).join(tables.embeddings(spark, d), "chunk_id", "left")
    return found.select("chunk_id", F.coalesce(F.size("embedding"), F.lit(0)).alias("dimensions"))


def _both(spark, d):
    chunks = tables.chunks(spark, d)
    asked = _queries(spark, QUERY)
    n = hybrid.over_fetch(LIMIT)
    stored = tables.embeddings(spark, d)
    vectors = stored.where("chunk_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return chunks, asked, lexical.search_batch(lexical.Index.build(chunks), asked, n), vector.search_batch(stored, vectors, n)


def rrf_fusion(spark, d):
    _, _, a, b = _both(spark, d)
    return hybrid.fused(a, b).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "lexical_rank", "vector_rank")


def hybrid_search(spark, d):
    chunks, asked, a, b = _both(spark, d)
    return _ranked(hybrid.search_batch(a, b, chunks, asked, LIMIT))


def _edges(df):
    return df.select("from_chunk_id", "to_chunk_id", "to_name", "edge_type", "weight", "resolved")


def edges_contains(spark, d):
    return _edges(graph.contains_edges(tables.graph_chunks(spark, d)))


def edges_heritage(spark, d):
    return _edges(graph.heritage_edges(tables.graph_chunks(spark, d)))


def edges_calls(spark, d):
    return _edges(graph.call_edges(tables.chunks(spark, d)))


def edge_counts(spark, d):
    found = graph.edges(tables.graph_chunks(spark, d))
    return found.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved"))


def ambiguous_names(spark, d):
    chunks = tables.chunks(spark, d).where(F.col("chunk_type").isin(*graph.CALLABLE))
    return chunks.groupBy(scalars.short_name(F.col("name")).alias("short")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def graph_seeds(spark, d):
    found = graph.name_seeds(tables.graph_chunks(spark, d), _queries(spark, SYMBOL_QUERY))
    return found.select("query_id", "chunk_id", "score", "seed")


def _seeds(spark, d):
    chunks, asked = tables.graph_chunks(spark, d), _queries(spark, SYMBOL_QUERY)
    lexical_rows = lexical.search_batch(lexical.Index.build(chunks), asked, graph.SEEDS)
    # Seeds and edges are used level by level, so each is made once.
    seeds = written(graph.all_seeds(graph.name_seeds(chunks, asked), lexical_rows), "seeds")
    return chunks, seeds, written(graph.edges(chunks), "edges")


def graph_expansion(spark, d):
    _, seeds, edges = _seeds(spark, d)
    found = graph.expanded(seeds, edges)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "level")


def graph_search(spark, d):
    chunks, seeds, edges = _seeds(spark, d)
    return _ranked(graph.search_batch(chunks, edges, seeds, LIMIT, n_queries=1))


def type_multipliers(spark, d):
    chunks = tables.chunks(spark, d)
    value = scalars.type_multiplier(F.col("chunk_type"), F.col("name"))
    return chunks.groupBy("chunk_type").agg(F.round(F.sum(value), 4).alias("total"))


def checksum_status(spark, d):
    """Documents as stored, against all of them with the French ones edited, and the pages as new files."""
    docs, pages = tables.read(spark, d, "documents"), tables.read(spark, d, "pages")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_path")
    stored = docs.select(path, files.checksum(F.col("text")).alias("checksum"))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("source_path")
    incoming = docs.select(path, files.checksum(text).alias("checksum")).unionByName(
        pages.select(new, files.checksum(F.col("html")).alias("checksum"))
    )
    return files.change_status(incoming, stored).select("source_path", "checksum", "status")


def job_counts(spark, d):
    return checksum_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert_documents(spark, d):
    """All but the German documents updated, the pages inserted."""
    docs, pages = tables.read(spark, d, "documents"), tables.read(spark, d, "pages")
    stored = docs.select("doc_id", "lang", "source", "n_chars")
    update = docs.where("lang <> 'de'").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"))
    insert = pages.select((-1 - F.col("page_id")).alias("doc_id"), F.length("html").cast("long").alias("n_chars"))
    incoming = update.unionByName(insert).select("doc_id", F.lit("xx").alias("lang"), F.lit("new").alias("source"), "n_chars")
    return store.upserted(stored, incoming, "doc_id", kept=("lang",))


def cascade_delete(spark, d):
    chunks = tables.graph_chunks(spark, d)
    edges = graph.edges(chunks)
    documents = chunks.select("document_id").distinct()
    gone = documents.where("document_id = '2'")
    left = store.without_documents({"documents": documents, "chunks": chunks, "edges": edges}, gone)
    return _edges(left["edges"])


def skip_reasons(spark, d):
    pages = tables.read(spark, d, "pages")
    path = F.regexp_replace("url", r"[?#].*$", "")
    size = F.octet_length("html")
    reason = files.skip_reason(path, size, 20_000, ("**/fr/*",))
    return pages.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def path_parts(spark, d):
    pages = tables.read(spark, d, "pages")
    path = F.regexp_replace("url", r"[?#].*$", "")
    return pages.select(
        "page_id",
        scalars.basename(path).alias("name"),
        scalars.first_dot_extension(path).alias("first_dot"),
        scalars.last_dot_extension(path).alias("last_dot"),
    )


def breadcrumbs(spark, d):
    chunks = tables.graph_chunks(spark, d)
    m = F.col("metadata")
    text = scalars.breadcrumb(F.col("document_id"), F.col("chunk_type"), F.col("name"), m["parentName"], m["signature"])
    return chunks.select("chunk_id", text.alias("breadcrumb"))


def embedding_text(spark, d):
    none = F.lit(None).cast("string")
    own = [F.col(c) for c in ("language", "chunk_type", "name", "content")]
    return tables.chunks(spark, d).select("chunk_id", F.sha2(scalars.embedding_text(*own, none, none, none), 256).alias("text_sha"))


def preview_lines(spark, d):
    return lookup.previews(tables.chunks(spark, d), 3)


def _mapped(spark, d):
    chunks = tables.graph_chunks(spark, d).withColumn("start_line", F.regexp_replace("chunk_id", "[a-z]", "").cast("int"))
    documents = chunks.select("document_id").distinct().select(
        "document_id", F.col("document_id").alias("source_path"), F.lit("tpch").alias("language")
    )
    return documents, chunks


def project_map(spark, d):
    return lookup.project_map(*_mapped(spark, d)).select("source_path", F.sha2("block", 256).alias("block_sha"))


def project_map_lines(spark, d):
    """The map a row a line, as its sink writes it."""
    return lookup.map_lines(*_mapped(spark, d)).select(*lookup.MAP_ORDER)


def term_counts_in_row(spark, d):
    found = tables.chunks(spark, d).select("chunk_id", terms(F.col("content")).alias("t"))
    return found.select("chunk_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_terms, camel_split, emitted_terms, term_frequencies, doc_lengths, corpus_stats, document_frequency, idf,
        bm25_search, bm25_batch, bm25_conversations, filtered_search, hydrate_chunks, name_match, find_symbol, find_symbol_typed, part_names,
        file_context, chunks_of_document, point_lookup, documents_listing, stats_totals, stats_by_language, stats_by_type,
        stats_last_indexed, json_metadata, stats_postings, vector_search, vector_batch, embedding_dims, unembedded,
        with_embedding, rrf_fusion, hybrid_search, edges_contains, edges_heritage, edges_calls, edge_counts,
        ambiguous_names, graph_seeds, graph_expansion, graph_search, type_multipliers, checksum_status, job_counts,
        upsert_documents, cascade_delete, skip_reasons, path_parts, breadcrumbs, embedding_text, preview_lines,
        project_map, project_map_lines, term_counts_in_row,
    )
}
