"""Registered queries of scanning, storing and indexing over whole tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import scalars
from tarn.operators import graph, lexical, vector
from tarn.plans import indexing, tables
from tarn.plans.oracles import _CH, _G, _GE, _IGNORED, _P, _terms
from tarn.sources import files, store
from tarn.sources.embedding import HashingProvider, embedded
from tarn.schemas import METADATA

DIMENSIONS = 64
FILE = ("document_id", "source_path", "checksum", "chunk_count", "job_id", "language", "name", "created_at")


def scan_listing(spark, d):
    found = files.classified(tables.listing(spark, d), 20_000, ("**/lib/*",))
    return found.select("path", "extension", "language", "skip_reason")


def scan_summary(spark, d):
    found = files.scan_summary(files.classified(tables.listing(spark, d), 20_000, ("**/lib/*",)))
    return found.select("reason", "files", F.array_join("extensions", ",").alias("extensions"))


def scan_totals(spark, d):
    return files.scan_totals(files.classified(tables.listing(spark, d), 20_000, ("**/lib/*",)))


def parser_dispatch(spark, d):
    """Files of each parser among those that no rule leaves out."""
    found = files.classified(tables.listing(spark, d)).where(F.col("skip_reason").isNull() & F.col("language").isNotNull())
    return found.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def _run(spark, d):
    stored, listing = tables.stored_files(spark, d), tables.incoming_files(spark, d)
    work = files.change_status(listing, stored).where("status <> 'unchanged'")

    def chunks(of):
        return of.select(F.concat("document_id", F.lit("#0")).alias("chunk_id"), "document_id", "content")

    old = chunks(stored)
    vectors = old.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"))
    have = {"documents": stored.select(*FILE), "chunks": old, "postings": lexical.postings(old), "embeddings": vectors}
    return indexing.reindexed(have, work.select(*FILE), chunks(work))


def reindexed_documents(spark, d):
    """Only new and changed files take the later job; those that were stored keep their creation."""
    return _run(spark, d)["documents"].select("source_path", "checksum", "chunk_count", "job_id", "created_at")


def reindexed_chunks(spark, d):
    """Chunks of changed files are purged and made again; others stay."""
    return _run(spark, d)["chunks"].select("chunk_id", "document_id", F.sha2("content", 256).alias("content_sha"))


def reindexed_postings(spark, d):
    found = _run(spark, d)["postings"]
    return found.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("frequency").alias("frequency"), F.max("doc_len").alias("doc_len")
    )


def reindexed_pending(spark, d):
    """Chunks left to embed: those of new files, and of changed ones, whose vectors went with their chunks."""
    out = _run(spark, d)
    return vector.pending(out["chunks"].withColumn("created_at", F.col("chunk_id")), out["embeddings"]).select("chunk_id")


def vanished_documents(spark, d):
    """Stored files that the new listing lacks: here the labelled documents are what is left."""
    docs, labels = tables.stored_files(spark, d), tables.read(spark, d, "labels")
    left = labels.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_path"))
    gone = indexing.vanished(docs, left, "doc")
    return docs.join(gone, "document_id", "left_semi").select("source_path")


def upsert_chunks(spark, d):
    """Incoming chunks change content and metadata only; new ones are taken whole."""
    docs, pages = tables.read(spark, d, "documents"), tables.read(spark, d, "pages")
    stored = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", F.lit("a").alias("metadata"))
    edited = docs.where("lang = 'fr'").select(
        F.col("doc_id").alias("chunk_id"), F.concat("text", F.lit("!")).alias("content"), F.lit("x").alias("lang"), F.lit("b").alias("metadata")
    )
    new = pages.select((-1 - F.col("page_id")).alias("chunk_id"), F.col("html").alias("content"), F.lit("x").alias("lang"), F.lit("b").alias("metadata"))
    out = store.upserted(stored, edited.unionByName(new), "chunk_id", updated=("content", "metadata"))
    return out.select("chunk_id", "lang", "metadata", F.sha2("content", 256).alias("content_sha"))


def upsert_embeddings(spark, d):
    """Vectors of label 0 again, reversed, and of the documents as new: one variant keeps the creation, one resets it."""
    rows, docs = tables.read(spark, d, "embeddings"), tables.read(spark, d, "documents")
    stored = rows.select("vec_id", "embedding", F.lit("old").alias("created"))
    again = rows.where("label = 0").select("vec_id", F.reverse("embedding").alias("embedding"), F.lit("new").alias("created"))
    new = docs.select((-1 - F.col("doc_id")).alias("vec_id"), F.array(F.lit(0.5).cast("float")).alias("embedding"), F.lit("new").alias("created"))
    incoming = again.unionByName(new)
    kept = store.upserted(stored, incoming, "vec_id", kept=("created",)).select("vec_id", F.col("created").alias("kept"))
    reset = store.upserted(stored, incoming, "vec_id")
    return reset.join(kept, "vec_id").select("vec_id", F.element_at("embedding", 1).cast("double").alias("first"), "kept", F.col("created").alias("reset"))


def update_checksum(spark, d):
    docs = tables.stored_files(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp"))
    one = spark.range(1).select(F.sha2(F.lit("doc/7"), 256)).first()[0]
    found = store.with_checksum(docs, one, "f" * 64)
    return found.select("source_path", "checksum", F.col("updated_at").isNotNull().alias("touched"))


def migrate_postings(spark, d):
    """Postings of the layout without lengths, brought up to the present one."""
    old = lexical.postings(tables.chunks(spark, d)).drop("doc_len")
    return lexical.with_lengths(old).select("chunk_id", "term", "frequency", "doc_len")


def _metadata():
    return F.lit(None).cast(METADATA).alias("metadata")


def _vectors(texts):
    found = embedded(texts.withColumn("chunk_id", F.col("chunk_id").cast("string")), HashingProvider(DIMENSIONS))
    size = F.round(scalars.norm(F.col("embedding")), 3)
    return found.select("chunk_id", "model_name", "dimensions", size.alias("norm"))


def embed_pending(spark, d):
    """Chunks without a vector get one."""
    chunks = tables.chunks(spark, d).withColumns(
        {"created_at": F.col("chunk_id"), "metadata": _metadata(), "breadcrumb": F.concat(F.lit("File: "), "document_id")}
    )
    return _vectors(vector.embedding_texts(vector.pending(chunks, tables.embeddings(spark, d))))


def embed_document(spark, d):
    """All chunks of one file, embedded again without the breadcrumb line."""
    chunks = tables.chunks(spark, d).withColumn("metadata", _metadata()).where("document_id = 'src3'")
    return _vectors(vector.embedding_texts(chunks, with_breadcrumb=False))


def readiness(spark, d):
    chunks = tables.graph_chunks(spark, d)
    found = vector.readiness(lexical.postings(tables.chunks(spark, d)), tables.embeddings(spark, d), graph.contains_edges(chunks), DIMENSIONS)
    return found.select("strategy", "ready")


def index_progress(spark, d):
    """By language: chunks, those with a vector, and the whole percent of them."""
    have = tables.embeddings(spark, d).select("chunk_id", F.lit(1).alias("have"))
    found = tables.chunks(spark, d).join(have, "chunk_id", "left").groupBy("language")
    found = found.agg(F.count(F.lit(1)).alias("chunks"), F.count("have").alias("embedded"))
    return found.withColumn("percent", scalars.percent(F.col("embedded"), F.col("chunks")))


def readable_figures(spark, d):
    """Sizes and durations as a status shows them, with a customer's orders as bytes and milliseconds."""
    orders = tables.read(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("n"))
    return orders.select(
        "o_custkey",
        scalars.readable_bytes(F.col("n")).alias("bytes"),
        scalars.readable_bytes(F.col("n") * 1000).alias("more_bytes"),
        scalars.readable_bytes(F.col("o_custkey") % 2000).alias("few_bytes"),
        scalars.readable_duration(F.col("n")).alias("duration"),
        scalars.readable_duration(F.col("o_custkey") % 70_000).alias("short_duration"),
    )


def signature_lines(spark, d):
    docs = tables.read(spark, d, "documents")
    text = F.concat_ws(" \n\t ", "source", "text", F.lit(" "))
    name = F.concat("source", F.lit(" <"), "lang", F.lit("<T>>"))
    return docs.select("doc_id", F.sha2(scalars.squeezed(text), 256).alias("signature_sha"), scalars.without_generics(name).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_listing, scan_summary, scan_totals, parser_dispatch, reindexed_documents, reindexed_chunks, reindexed_postings,
        reindexed_pending, vanished_documents, upsert_chunks, upsert_embeddings, update_checksum, migrate_postings,
        embed_pending, embed_document, readiness, index_progress, readable_figures, signature_lines,
    )
}


def _pick(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST(doc_id % {len(values)} AS INTEGER) + 1]"


_DIRECTORIES = ", ".join(f"'{d}'" for d in files.IGNORED_DIRECTORIES)
_L = rf"""l0 AS (SELECT source || '/' || {_pick(tables.FOLDERS)} || '/' || lang || doc_id || {_pick(tables.EXTENSIONS)} AS relative,
    strlen(text) AS size_bytes FROM documents),
  l1 AS (SELECT *, string_split(relative, '/') AS s, string_split(relative, '/')[-1] AS base FROM l0),
  l2 AS (SELECT *, lower(regexp_extract(base, '(\..*)$', 1)) AS extension, regexp_extract(base, '(\.[^.]*)$', 1) AS tail FROM l1),
  l AS (SELECT '/tree/' || relative AS path, extension, size_bytes,
    CASE WHEN tail IN ('.ts', '.tsx') THEN 'typescript' WHEN tail IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript'
      WHEN tail IN ('.py', '.pyw') THEN 'python' WHEN tail = '.java' THEN 'java' END AS language,
    CASE WHEN len(list_filter(s[1:len(s) - 1], lambda x: starts_with(x, '.') OR x IN ({_DIRECTORIES}))) > 0 THEN 'ignored_directory'
      WHEN starts_with(base, '.') THEN 'hidden_file' WHEN extension IN ({_IGNORED}) THEN 'ignored_extension'
      WHEN ends_with(base, '.d.ts') THEN 'declaration_file' WHEN size_bytes > MOST THEN 'too_large'
      WHEN size_bytes = 0 THEN 'empty_file' EXCLUDED END AS skip_reason FROM l2)"""
_LISTED = _L.replace("MOST", "20000").replace(
    "EXCLUDED", "WHEN regexp_matches('/tree/' || relative, '.[^/]*/lib/[^/]*') THEN 'exclude_pattern'"
)
_NOW = """now AS (SELECT sha256('doc/' || doc_id) AS id, 'doc/' || doc_id AS path, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS t,
    CASE WHEN lang = 'fr' THEN 'second' ELSE 'first' END AS job, 'first' AS made FROM documents
  UNION ALL SELECT sha256('page/' || page_id), 'page/' || page_id, html, 'second', 'second' FROM pages)"""
_TENTHS = "printf('%.1f', floor({0} * 10 + 0.5) / 10)"


def _bytes(n: str) -> str:
    kb, mb, gb = (_TENTHS.format(f"({n} / {1024**i})") for i in (1, 2, 3))
    return f"""CASE WHEN {n} < 1024 THEN CAST({n} AS BIGINT) || ' B' WHEN {n} < 1048576 THEN {kb} || ' KB'
      WHEN {n} < 1073741824 THEN {mb} || ' MB' ELSE {gb} || ' GB' END"""


def _duration(n: str) -> str:
    return f"""CASE WHEN {n} < 1000 THEN CAST({n} AS BIGINT) || 'ms' WHEN {n} < 60000 THEN {_TENTHS.format(f"({n} / 1000)")} || 's'
      ELSE CAST(floor({n} / 60000) AS BIGINT) || 'm ' || CAST(floor({n} / 1000) % 60 AS BIGINT) || 's' END"""


_TEXT_64 = f"'hashing' AS model_name, CAST({DIMENSIONS} AS INTEGER) AS dimensions, 1.0::DOUBLE AS norm"
ORACLES = {
    "scan_listing": f"WITH {_LISTED} SELECT path, extension, language, skip_reason FROM l",
    "scan_summary": f"""WITH {_LISTED} SELECT skip_reason AS reason, count(*) AS files,
        string_agg(DISTINCT extension, ',' ORDER BY extension) AS extensions FROM l GROUP BY skip_reason""",
    "scan_totals": f"WITH {_LISTED} SELECT count(*) AS scanned, count(skip_reason) AS skipped, count(*) - count(skip_reason) AS kept FROM l",
    "parser_dispatch": f"""WITH {_L.replace("MOST", str(files.MAX_FILE_BYTES)).replace("EXCLUDED", "")}
        SELECT language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM l
        WHERE skip_reason IS NULL AND language IS NOT NULL GROUP BY language""",
    "reindexed_documents": f"""WITH {_NOW} SELECT path AS source_path, sha256(t) AS checksum, CAST(1 AS BIGINT) AS chunk_count,
        job AS job_id, made AS created_at FROM now""",
    "reindexed_chunks": f"WITH {_NOW} SELECT id || '#0' AS chunk_id, id AS document_id, sha256(t) AS content_sha FROM now",
    "reindexed_postings": f"""WITH {_NOW}, {_terms("now", "id || '#0'", "t")} SELECT chunk_id, count(*) AS terms,
        CAST(sum(frequency) AS BIGINT) AS frequency, CAST(sum(frequency) AS BIGINT) AS doc_len FROM p GROUP BY chunk_id""",
    "reindexed_pending": f"WITH {_NOW} SELECT id || '#0' AS chunk_id FROM now WHERE job = 'second'",
    "vanished_documents": """SELECT 'doc/' || doc_id AS source_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "upsert_chunks": """SELECT doc_id AS chunk_id, lang, CASE WHEN lang = 'fr' THEN 'b' ELSE 'a' END AS metadata,
          sha256(CASE WHEN lang = 'fr' THEN text || '!' ELSE text END) AS content_sha FROM documents
        UNION ALL SELECT -1 - page_id, 'x', 'b', sha256(html) FROM pages""",
    "upsert_embeddings": """SELECT vec_id, CAST(CASE WHEN label = 0 THEN embedding[-1] ELSE embedding[1] END AS DOUBLE) AS first, 'old' AS kept,
          CASE WHEN label = 0 THEN 'new' ELSE 'old' END AS reset FROM embeddings
        UNION ALL SELECT -1 - doc_id, 0.5, 'new', 'new' FROM documents""",
    "update_checksum": """SELECT 'doc/' || doc_id AS source_path, CASE WHEN doc_id = 7 THEN repeat('f', 64) ELSE sha256(text) END AS checksum,
        doc_id = 7 AS touched FROM documents""",
    "migrate_postings": f"""WITH {_P} SELECT chunk_id, term, frequency,
        CAST(sum(frequency) OVER (PARTITION BY chunk_id) AS BIGINT) AS doc_len FROM p""",
    "embed_pending": f"""SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_TEXT_64} FROM documents
        WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "embed_document": f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_TEXT_64} FROM documents WHERE source = 'src3'",
    "readiness": f"""WITH {_P}, {_G}, {_GE}, b AS (SELECT count(*) > 0 AS r FROM p),
        v AS (SELECT count(*) > 0 AND coalesce(bool_and(len(embedding) = {DIMENSIONS}), false) AS r FROM embeddings),
        e AS (SELECT count(*) FILTER (resolved) > 0 AS r FROM ge_contains)
        SELECT 'bm25' AS strategy, r AS ready FROM b UNION ALL SELECT 'vector', r FROM v
        UNION ALL SELECT 'hybrid', b.r AND v.r FROM b, v UNION ALL SELECT 'graph', r FROM e""",
    "index_progress": f"""WITH {_CH} SELECT language, count(*) AS chunks, count(vec_id) AS embedded,
        CAST(floor(100.0::DOUBLE * count(vec_id) / count(*) + 0.5) AS INTEGER) AS percent
        FROM ch LEFT JOIN embeddings ON chunk_id = vec_id GROUP BY language""",
    "readable_figures": f"""SELECT o_custkey, {_bytes("n")} AS bytes, {_bytes("(n * 1000)")} AS more_bytes,
        {_bytes("(o_custkey % 2000)")} AS few_bytes, {_duration("n")} AS duration, {_duration("(o_custkey % 70000)")} AS short_duration
        FROM (SELECT o_custkey, CAST(sum(floor(o_totalprice)) AS BIGINT) AS n FROM orders GROUP BY o_custkey)""",
    "signature_lines": r"""SELECT doc_id, sha256(trim(regexp_replace(source || e' \n\t ' || text || e' \n\t  ', '\s+', ' ', 'g'), ' ')) AS signature_sha,
        source AS name FROM documents""",
}
