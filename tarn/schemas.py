"""Table schemas of a context."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNK_TYPES = (
    "function", "method", "class", "interface", "type", "struct", "enum", "trait", "impl", "module", "paragraph",
)
LANGUAGES = ("typescript", "javascript", "python", "java", "unknown")
STRATEGIES = ("bm25", "vector", "hybrid", "graph")
#: Version of the layout below; an older store is brought up to it, a newer one refused.
VERSION = 3

METADATA = T.StructType(
    [
        T.StructField("signature", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("parentName", T.StringType()),
        T.StructField("returnType", T.StringType()),
        T.StructField("isExported", T.BooleanType()),
        T.StructField("isAsync", T.BooleanType()),
        T.StructField("parameters", T.ArrayType(T.StringType())),
        T.StructField("extendsNames", T.ArrayType(T.StringType())),
        T.StructField("implementsNames", T.ArrayType(T.StringType())),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("chunk_count", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("metadata", METADATA),
        T.StructField("breadcrumb", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
EMBEDDINGS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model_name", T.StringType()),
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
POSTINGS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("frequency", T.LongType()),
        T.StructField("doc_len", T.LongType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("from_chunk_id", T.StringType()),
        T.StructField("to_chunk_id", T.StringType()),
        T.StructField("to_name", T.StringType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("resolved", T.BooleanType()),
    ]
)
#: Blocks of a term's postings in a bucket, with what bounds their scores.
BLOCKS = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("low", T.StringType()),
        T.StructField("high", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("most", T.LongType()),
        T.StructField("spread", T.DoubleType()),
        T.StructField(
            "postings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("chunk_id", T.StringType()),
                        T.StructField("frequency", T.LongType()),
                        T.StructField("doc_len", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
#: A bucket's chunks with a term, and the sum of their lengths.
STATISTICS = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("terms", T.LongType()),
    ]
)
JOBS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("new", T.LongType()),
        T.StructField("changed", T.LongType()),
        T.StructField("unchanged", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)
TABLES = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "embeddings": EMBEDDINGS,
    "postings": POSTINGS,
    "edges": EDGES,
    "blocks": BLOCKS,
    "statistics": STATISTICS,
    "jobs": JOBS,
}
