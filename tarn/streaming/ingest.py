"""Streaming ingest: chunks become postings, and versions of files keep a store up to date, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarn.operators import lexical
from tarn.plans import indexing
from tarn.sources import files
from tarn.sources.scratch import written
from tarn.sources.store import Store
from tarn.sources.symbols import parsed

#: Arriving versions of files: ``at`` orders those of one batch, a null text is a deletion.
VERSIONS = "source_path string, text string, at long"


def term_stream(chunks: DataFrame) -> DataFrame:
    """A stream of (chunk_id, content) as a stream of (chunk_id, doc_len, terms); no state is kept."""
    return lexical.term_rows(chunks)


def follow(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append the postings of every Parquet file that arrives in ``source`` to ``target``.

    Each batch writes its own directory, named by its number: a batch that is run again after a
    failure replaces what it left. The query processes what is there and ends.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        lexical.postings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keep(store: Store, source: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Bring ``store`` up to date with versions of files that arrive in ``source`` as Parquet (VERSIONS).

    What a batch changes goes out of the index and comes in again in one commit, of the buckets
    touched only: an edited file never counts twice. A batch that is run again finds its files
    unchanged and writes nothing. The query processes what is there and ends.
    """
    arriving = store.spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        arriving.writeStream.foreachBatch(lambda batch, number: take_in(store, batch, f"batch-{number}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def take_in(store: Store, versions: DataFrame, job_id: str) -> None:
    """Apply versions of files to the store: of each path the last; files of no known language are left out.

    A file that can't be parsed keeps what was stored of it.
    """
    store.refresh()
    last = F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("at"), F.col("text").asc_nulls_last()))
    newest = written(versions.withColumn("last", last).where("last = 1").drop("last", "at"), "arrived")
    stored = store.table("documents")
    gone = stored.join(newest.where("text is null").select("source_path"), "source_path", "left_semi").select("document_id")
    texts = newest.where("text is not null").withColumn("language", files.language_of(F.col("source_path")))
    texts = texts.where("language is not null").withColumn("checksum", files.checksum(F.col("text")))
    texts = texts.withColumn("size_bytes", F.octet_length("text").cast("long"))
    work = written(files.change_status(texts, stored).where("status <> 'unchanged'"), "arrived-changes")
    if work.isEmpty() and gone.isEmpty():
        return
    symbols = written(parsed(work), "arrived-symbols")
    _, incoming, fresh = indexing.documents_of(work, symbols, job_id)
    indexing.apply(store, incoming, fresh, gone)
