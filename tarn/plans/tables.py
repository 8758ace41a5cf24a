"""The engine's tables as views of a folder of Parquet tables without source code.

Documents stand in for chunks, their sources for files, and the nations, regions, suppliers and
customers for classes, interfaces and methods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.schemas import METADATA

TYPES = ("function", "method", "class", "interface", "type")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.regexp_extract("text", "([A-Za-z0-9_]+)", 1).alias("name"),
        kind.alias("chunk_type"),
        F.lit(1).alias("start_line"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("document_id")).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.max("doc_id").alias("updated_at")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def graph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as interfaces, nations as classes, suppliers and customers as methods of nations."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    none = F.array().cast("array<string>")

    def metadata(**given):
        fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields]
        return F.struct(*fields).alias("metadata")

    def rows(df, prefix, key, document, name, kind, **given):
        return df.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("chunk_id"),
            F.col(document).cast("string").alias("document_id"),
            name.alias("name"),
            F.lit(kind).alias("chunk_type"),
            name.alias("content"),
            metadata(**given),
        )

    extends = F.array(F.col("r_name"), F.lit("MISSING"))
    with_region = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    out = rows(region, "r", "r_regionkey", "r_regionkey", F.col("r_name"), "interface").unionByName(
        rows(with_region, "n", "n_nationkey", "n_regionkey", F.col("n_name"), "class", extendsNames=extends, implementsNames=none)
    )
    for table, prefix in (("supplier", "s"), ("customer", "c")):
        people = read(spark, sf_dir, table)
        people = people.join(F.broadcast(nation), people[f"{prefix}_nationkey"] == nation.n_nationkey)
        name = F.concat("n_name", F.lit("."), F.col(f"{prefix}_name"))
        key = {"s": "s_suppkey", "c": "c_custkey"}[prefix]
        out = out.unionByName(rows(people, prefix, key, "n_regionkey", name, "method", parentName=F.col("n_name")))
    return out


#: What stands in for directories and extensions of the listing's files.
FOLDERS = ("src", "src/.cache", "node_modules/a", "lib/_x", ".git", "a.b/build")
EXTENSIONS = (".ts", ".d.ts", ".test.js", ".py", ".PY", ".java", ".md", "", ".tsx", ".min.js", ".cjs")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree that was listed whole; the path comes from the columns."""
    docs = read(spark, sf_dir, "documents")

    def pick(values: tuple[str, ...]):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))

    relative = F.concat_ws("/", "source", pick(FOLDERS), F.concat("lang", F.col("doc_id").cast("string"), pick(EXTENSIONS)))
    return docs.select(
        F.concat(F.lit("/tree/"), relative).alias("path"), relative.alias("relative"), F.octet_length("text").cast("long").alias("size_bytes")
    )


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that an earlier job has stored, a chunk each."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select(*_file(path, "text", "first"), F.col("text").alias("content"))


def incoming_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a later job: the documents, the French ones edited, and the pages as new files."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    docs = docs.withColumn("new_text", text).select(*_file(path, "new_text", "second"), F.col("new_text").alias("content"))
    path = F.concat(F.lit("page/"), F.col("page_id").cast("string"))
    return docs.unionByName(pages.select(*_file(path, "html", "second"), F.col("html").alias("content")))


def _file(path, text: str, job: str) -> list:
    return [
        F.sha2(path, 256).alias("document_id"),
        path.alias("source_path"),
        F.sha2(text, 256).alias("checksum"),
        F.lit(1).cast("long").alias("chunk_count"),
        F.lit(job).alias("job_id"),
        F.lit("text").alias("language"),
        path.alias("name"),
        F.lit(job).alias("created_at"),
    ]
