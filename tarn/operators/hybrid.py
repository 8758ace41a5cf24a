"""Hybrid search: weighted reciprocal-rank fusion of two rankings, then a boost by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalars import RRF_K, boost_terms, name_boost
from tarn.operators.lexical import normalised, sent, top


def fused(lexical: DataFrame, vector: DataFrame, weight: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, lexical_rank, vector_rank), score over the query's best.

    Ties keep the lexical list first, then the vector list.
    """
    a = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    b = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full")

    def share(w: float, rank: str):
        return F.coalesce(F.lit(w) / (RRF_K + F.col(rank)), F.lit(0.0))

    return normalised(both.withColumn("score", share(weight, "lexical_rank") + share(1 - weight, "vector_rank")))


def search_batch(
    lexical: DataFrame, vector: DataFrame, names: DataFrame, queries: DataFrame, limit: int = 10, weight: float = 0.5
) -> DataFrame:
    """(query_id, chunk_id, score, rank) from rankings that were over-fetched at 2 * limit.

    ``names`` has (chunk_id, name), ``queries`` (query_id, text). Rows without a name are
    dropped. After the boost, equal scores keep their order before it.
    """
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", 9).desc(), F.col("lexical_rank").asc_nulls_last(), "vector_rank"
    )
    before = fused(lexical, vector, weight).withColumn("before", F.row_number().over(order))
    words = queries.select("query_id", boost_terms(F.col("text")).alias("words"))
    boosted = (
        sent(before.where(F.col("before") <= 4 * limit), queries.count() * 4 * limit)
        .join(names.select("chunk_id", "name"), "chunk_id")
        .join(words, "query_id")
        .withColumn("score", name_boost(F.col("score"), F.col("name"), F.col("words")))
    )
    return top(boosted, limit, "before").select("query_id", "chunk_id", "score", "rank")


def over_fetch(limit: int) -> int:
    return 2 * limit
