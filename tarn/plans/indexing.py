"""The incremental indexing pipeline: scan, compare, parse, postings, edges, one commit of the buckets that change."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import schemas
from tarn.functions.scalars import basename
from tarn.operators import graph, lexical, vector
from tarn.operators.lookup import write_project_map
from tarn.sources import files as scanner
from tarn.sources.embedding import Provider, embedded
from tarn.sources.scratch import written
from tarn.sources.store import Conflict, Store, upserted, without_documents
from tarn.sources.symbols import chunk_rows, parsed


#: How often a job's row is tried to be added while other jobs end.
LOG_TRIES = 5


@dataclass
class Job:
    path: str
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "completed"
    message: str | None = None
    new: int = 0
    changed: int = 0
    unchanged: int = 0
    failed: int = 0
    seconds: float = 0.0

    @property
    def processed(self) -> int:
        return self.new + self.changed + self.unchanged + self.failed


def index(
    store: Store, path: str, force: bool = False, prune: bool = False, max_bytes: int = scanner.MAX_FILE_BYTES,
    exclude: tuple[str, ...] = (), provider: Provider | None = None,
) -> Job:
    """Index the tree at ``path`` into ``store``.

    Unchanged files are skipped unless ``force``; a file that fails alone is counted and left
    out; a failure of the whole job is reported in the job and changes nothing. Files that
    vanished stay indexed unless ``prune``. With a ``provider``, pending chunks are embedded.
    """
    job, began = Job(path), time.time()
    started = datetime.now(timezone.utc)
    try:
        _index(store, job, force, prune, max_bytes, exclude)
        if provider is not None:
            embed_pending(store, provider)
    except Exception as failure:  # the job's status carries it
        job.status, job.message = "failed", f"{type(failure).__name__}: {failure}"[:2000]
    job.seconds = time.time() - began
    row = (job.job_id, path, job.status, job.message, job.new, job.changed, job.unchanged, job.failed, started, job.seconds)
    log = store.spark.createDataFrame([row], schemas.JOBS)
    for _ in range(LOG_TRIES):
        try:
            store.commit(jobs=store.table("jobs").unionByName(log))
            break
        except Conflict:  # another job has ended just now: its tables and its row stay
            store.refresh()
        except Exception as failure:
            job.status, job.message = "failed", job.message or f"{type(failure).__name__}: {failure}"[:2000]
            break
    return job


def _index(store: Store, job: Job, force: bool, prune: bool, max_bytes: int, exclude: tuple[str, ...]) -> None:
    spark, kept_open = store.spark, []
    try:
        found = scanner.scan(spark, job.path, max_bytes, exclude)
        kept = found.where(F.col("skip_reason").isNull() & F.col("language").isNotNull())
        kept = kept.select("path", "language", "size_bytes")
        read = scanner.with_text(kept, job.path).where(F.col("text").isNotNull()).withColumnRenamed("path", "source_path")
        texts = read.withColumn("checksum", scanner.checksum(F.col("text"))).persist()
        kept_open.append(texts)
        documents = store.table("documents")
        status = scanner.change_status(texts, documents, force)
        counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
        job.unchanged = counts.get("unchanged", 0)
        work = status.where(F.col("status") != "unchanged")
        gone = vanished(documents, texts, job.path) if prune else None
        touched = counts.get("new", 0) + counts.get("changed", 0)
        if not touched and (gone is None or gone.isEmpty()):
            return
        symbols = parsed(work).persist()
        kept_open.append(symbols)
        fine, incoming, fresh = documents_of(work, symbols, job.job_id)
        done = {r["status"]: r["count"] for r in fine.groupBy("status").count().collect()}
        job.new, job.changed = done.get("new", 0), done.get("changed", 0)
        job.failed = touched - job.new - job.changed
        apply(store, incoming, fresh, gone)
        write_project_map(store.table("documents"), store.table("chunks"), f"{store.path}-project-map.txt", job.path)
    finally:
        for table in kept_open:
            table.unpersist()


def documents_of(work: DataFrame, symbols: DataFrame, job_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of files (source_path, language, checksum, size_bytes) and their symbols: those without error, as documents, and their chunks."""
    fine = work.join(symbols.where(F.col("error").isNotNull()).select("source_path"), "source_path", "left_anti")
    fresh = chunk_rows(symbols)
    sizes = fresh.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    imports = symbols.where(F.col("name").isNull()).select("source_path", "imports")
    now = F.current_timestamp()
    incoming = (
        fine.withColumn("document_id", F.sha2("source_path", 256))
        .join(sizes, "document_id", "left")
        .join(imports, "source_path", "left")
        .select(
            "document_id", "source_path", F.lit("filesystem").alias("source_type"), F.lit("code").alias("document_type"),
            "language", basename(F.col("source_path")).alias("name"), "checksum", "size_bytes",
            F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), F.lit(job_id).alias("job_id"),
            "imports", now.alias("created_at"), now.alias("updated_at"),
        )
    )
    return fine, incoming, fresh


def apply(store: Store, incoming: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> None:
    """Commit new and changed documents ``incoming`` with their chunks ``fresh``, and the deletion of ``gone``.

    Only buckets that hold one of these documents are read and written, and of edges those whose
    resolution changes; names of other chunks are read, their contents if a name they may call has a new owner.
    """
    changed = incoming.select("document_id") if gone is None else incoming.select("document_id").unionByName(gone)
    changed = written(changed.distinct(), "changed-documents")
    touched = store.touched(changed)
    incoming, fresh = (df.withColumn("bucket", store.bucket()) for df in (incoming, fresh))
    fresh = written(fresh, "fresh-chunks")
    tables = {n: store.table(n, touched, with_bucket=True) for n in ("documents", "chunks", "postings", "embeddings")}
    out = reindexed(tables, incoming, fresh, gone)
    chunks = store.table("chunks", with_bucket=True)
    others, old = chunks.join(changed, "document_id", "left_anti"), tables["chunks"].join(changed, "document_id", "left_semi")
    more, names = graph.edge_changes(others, old, fresh)
    home = others.select("chunk_id", "document_id").unionByName(fresh.select("chunk_id", "document_id"))
    more = written(store.with_home(more, home, "from_chunk_id"), "fresh-edges")
    stored = store.table("edges", with_bucket=True)
    flipped = more.select("bucket").unionByName(graph.outdated(stored, old, names).select("bucket")).distinct()
    # At most as many numbers as the store has buckets.
    buckets = sorted({*touched, *(r[0] for r in flipped.collect())})
    here = store.table("edges", buckets, with_bucket=True)
    left = here.join(graph.outdated(here, old, names).select("edge_id").distinct(), "edge_id", "left_anti")
    out["edges"] = left.unionByName(more.select(*here.columns)).dropDuplicates(["edge_id"])
    store.commit(**{n: (t, touched) for n, t in out.items() if n != "edges"}, edges=(out["edges"], buckets))


def vanished(documents: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """document_id of the documents below ``root`` that the listing (source_path) doesn't have any more."""
    below = documents.where(F.startswith("source_path", F.lit(root.rstrip("/") + "/")))
    return below.join(listing.select("source_path"), "source_path", "left_anti").select("document_id")


def reindexed(
    tables: dict[str, DataFrame], incoming: DataFrame, fresh: DataFrame, gone: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Documents, chunks, postings and embeddings after a run over new and changed documents.

    What was stored of ``incoming`` documents, and of those in ``gone``, is purged with all that
    hangs on it; ``fresh`` are the chunks of ``incoming``. A document without chunks is kept, so
    it isn't parsed again; one that was stored keeps its id, creation time, language and name.
    """
    documents = tables["documents"]
    stale = incoming.select("document_id").join(documents, "document_id", "left_semi")
    drop = stale if gone is None else stale.unionByName(gone)
    rest = without_documents({n: t for n, t in tables.items() if n != "edges"}, drop.distinct())
    merged = upserted(documents, incoming, "source_path", kept=("document_id", "created_at", "language", "name"))
    if gone is not None:
        merged = merged.join(gone, "document_id", "left_anti")
    found = lexical.postings(fresh)
    if "bucket" in fresh.columns:
        found = found.join(fresh.select("chunk_id", "bucket"), "chunk_id")
    return {
        "documents": merged,
        "chunks": rest["chunks"].unionByName(fresh.select(*rest["chunks"].columns)),
        "postings": rest["postings"].unionByName(found.select(*rest["postings"].columns)),
        "embeddings": rest["embeddings"],
    }


def embed_document(store: Store, provider: Provider, document_id: str) -> int:
    """Embed all chunks of one document again, without the breadcrumb line; their number."""
    chunks = store.table("chunks").where(F.col("document_id") == document_id)
    return _embed(store, provider, chunks, with_breadcrumb=False)


def embed_pending(store: Store, provider: Provider) -> int:
    """Embed the chunks without a vector; their number."""
    return _embed(store, provider, vector.pending(store.table("chunks"), store.table("embeddings")))


def _embed(store: Store, provider: Provider, chunks: DataFrame, with_breadcrumb: bool = True) -> int:
    n = chunks.count()
    if n:
        buckets = store.touched(chunks)
        fresh = store.with_home(embedded(vector.embedding_texts(chunks, with_breadcrumb=with_breadcrumb), provider), chunks)
        merged = upserted(store.table("embeddings", buckets, with_bucket=True), fresh, "chunk_id", kept=("created_at",))
        store.commit(embeddings=(merged, buckets))
    return n


def rebuild_postings(store: Store) -> None:
    chunks = store.table("chunks")
    store.commit(postings=store.with_home(lexical.postings(chunks), chunks))


def rebuild_edges(store: Store) -> None:
    chunks = store.table("chunks")
    store.commit(edges=store.with_home(graph.edges(chunks), chunks, "from_chunk_id"))


def statistics(spark: SparkSession, store: Store) -> dict[str, DataFrame | int]:
    from tarn.operators.lookup import counts_by, stats_totals

    chunks = store.table("chunks")
    return {
        "totals": stats_totals(store.table("documents")),
        "by_language": counts_by(chunks, "language"),
        "by_type": counts_by(chunks, "chunk_type"),
        "size_bytes": store.size_bytes(),
    }
