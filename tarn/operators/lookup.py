"""Lookups over the stored tables: hydration, symbols, files, project map, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalars import basename, name_like, preview
from tarn.operators.lexical import sent

#: The order of chunk types in a file's view; other types aren't shown.
TYPE_ORDER = ("class", "interface", "type", "function", "method")
FIND_LIMIT = 20


def hydrated(ranked: DataFrame, chunks: DataFrame, documents: DataFrame, strategy: str, most: int | None = None) -> DataFrame:
    """Result rows from (query_id, chunk_id, score, rank); ids without a chunk are dropped.

    Ranking comes first, so the few ranked rows, ``most`` if that is known, go to the wide tables
    and not the reverse.
    """
    wide = chunks.join(sent(ranked, most), "chunk_id")
    of = documents.select("document_id", "source_path", F.col("name").alias("doc_name"), "chunk_count")
    return wide.join(of, "document_id").select(
        "query_id", "chunk_id", "document_id", "name", "chunk_type", "language", "start_line", "end_line", "content",
        "metadata", "source_path", "doc_name", "chunk_count", "score", "rank", F.lit(strategy).alias("strategy"),
    )


def filtered(
    chunks: DataFrame, language: str | None = None, chunk_type: str | None = None, document_id: str | None = None
) -> DataFrame:
    for column, value in (("language", language), ("chunk_type", chunk_type), ("document_id", document_id)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    return chunks


def find_symbol(
    chunks: DataFrame, name: str, chunk_type: str | None = None, limit: int = FIND_LIMIT, documents: DataFrame | None = None
) -> DataFrame:
    """Chunks whose name contains ``name`` (any case, % and _ are wildcards), by name.

    With ``documents`` the rows carry their file's source_path; a chunk without a document goes
    before the cut.
    """
    found = filtered(chunks, chunk_type=chunk_type).where(name_like(F.col("name"), F.lit(name)))
    if documents is not None:
        found = found.join(documents.select("document_id", "source_path"), "document_id")
    return found.orderBy("name", "chunk_id").limit(limit)


def file_context(chunks: DataFrame, document_id: str) -> DataFrame:
    """A document's shown chunks, grouped by type in TYPE_ORDER, then by line."""
    order = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("chunk_type"))
    shown = chunks.where((F.col("document_id") == document_id) & F.col("chunk_type").isin(*TYPE_ORDER))
    return shown.withColumn("type_order", order.cast("int")).orderBy("type_order", "start_line", "chunk_id")


def stats_totals(documents: DataFrame) -> DataFrame:
    """One row: documents, chunks (as the documents count them), last update."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"),
        F.max("updated_at").alias("last_indexed"),
    )


def counts_by(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.groupBy(column).agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), column)


def _placed(chunks: DataFrame) -> DataFrame:
    """The map's lines of all shown chunks: (document_id, line) and the columns that order a file's lines."""
    m = F.col("metadata")
    label = F.coalesce(m["signature"], F.concat("name", F.lit("()")))
    kind = F.col("chunk_type")
    parent = F.when(kind == "method", m["parentName"]).when(kind == "class", F.col("name"))
    line = (
        F.when(kind == "class", F.concat(F.lit("  class "), "name"))
        .when(kind == "method", F.concat(F.lit("    "), label))
        .when(kind == "interface", F.concat(F.lit("  interface "), "name"))
        .when(kind == "type", F.concat(F.lit("  type "), "name"))
        .when(kind == "function", F.concat(F.lit("  fn "), label))
    )
    group = F.when(kind.isin("class", "method"), 0).when(kind == "interface", 1).when(kind == "type", 2).otherwise(3)
    owners = chunks.where(kind == "class").select("document_id", F.col("name").alias("owner"), F.col("start_line").alias("owner_line"))
    owners = owners.groupBy("document_id", "owner").agg(F.min("owner_line").alias("owner_line"))
    shown = chunks.where(kind.isin(*TYPE_ORDER)).select(
        "document_id", line.alias("line"), group.alias("g"), parent.alias("owner"), "start_line", (kind == "method").cast("int").alias("inner")
    )
    found = shown.join(owners, ["document_id", "owner"], "left").where((F.col("inner") == 0) | F.col("owner_line").isNotNull())
    return found.select("document_id", "g", F.coalesce("owner_line", "start_line").alias("at"), "inner", "start_line", "line")


def _head(root: str):
    relative = F.when(F.startswith("source_path", F.lit(root)), F.expr(f"substring(source_path, {len(root.rstrip('/')) + 2 if root else 1})")).otherwise(F.col("source_path"))
    return F.concat(relative, F.lit(" ["), "language", F.lit("]"))


#: What orders the lines of a map.
MAP_ORDER = ("source_path", "part", "g", "at", "inner", "start_line", "line")


def map_lines(documents: DataFrame, chunks: DataFrame, root: str = "") -> DataFrame:
    """The outline of all files, a row a line: MAP_ORDER's columns put them in order. No file is gathered."""
    none = [F.lit(0).alias(c) for c in ("g", "at", "inner", "start_line")]
    files = documents.select("source_path", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), t.alias("line")) for p, t in ((0, _head(root)), (2, F.lit("")))])).alias("l"))
    files = files.select("source_path", "l.part", *none, "l.line")
    shown = _placed(chunks).join(documents.select("document_id", "source_path"), "document_id")
    return files.unionByName(shown.select("source_path", F.lit(1).alias("part"), "g", "at", "inner", "start_line", "line"))


def project_map(documents: DataFrame, chunks: DataFrame, root: str = "") -> DataFrame:
    """(source_path, block): the outline of each file as one string; for maps of any size see ``map_lines``."""
    rows = F.array_sort(F.collect_list(F.struct("g", "at", "inner", "start_line", "line")))
    bodies = _placed(chunks).groupBy("document_id").agg(F.transform(rows, lambda r: r["line"]).alias("lines"))
    none = F.array().cast("array<string>")
    return documents.join(bodies, "document_id", "left").select(
        "source_path",
        F.array_join(F.concat(F.array(_head(root)), F.coalesce("lines", none), F.array(F.lit(""))), "\n").alias("block"),
    )


def project_map_text(documents: DataFrame, chunks: DataFrame, root: str = "") -> str:
    """The whole map with its header, for the text sink; it has some lines a file."""
    total = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
    lines = [r["line"] for r in map_lines(documents, chunks, root).orderBy(*MAP_ORDER).select("line").toLocalIterator()]
    return "\n".join(["# Project Map", f"# {total[0]} files | {total[1]} chunks", "", *lines])


def write_project_map(documents: DataFrame, chunks: DataFrame, path: str, root: str = "") -> None:
    """The map's lines as text files in order."""
    lines = map_lines(documents, chunks, root)
    lines.repartitionByRange(*MAP_ORDER).sortWithinPartitions(*MAP_ORDER).select("line").write.mode("overwrite").text(path)


def file_names(documents: DataFrame) -> DataFrame:
    return documents.withColumn("name", basename(F.col("source_path")))


def previews(chunks: DataFrame, lines: int) -> DataFrame:
    return chunks.select("chunk_id", preview(F.col("content"), lines).alias("preview"))


def newest_documents(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("updated_at"), "document_id")


def chunks_of(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("start_line", "chunk_id")


def ranked_within(rows: DataFrame, group: str, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("int"))
