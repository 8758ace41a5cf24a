"""Inverted index and BM25 search for one query or a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.scalars import idf, saturation
from tarn.functions.tokenize import is_term, is_whole, query_terms, terms, words

#: A table of query terms up to this size goes to every task; larger ones are joined by term.
BROADCAST_TERMS = 200_000


def sent(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` for a broadcast join if it is known to have few rows; else Spark chooses the join."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_TERMS else df


def term_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_len, terms): tokenised once a chunk; doc_len is known before any shuffle."""
    found = chunks.select("chunk_id", terms(F.col("content")).alias("terms"))
    return found.select("chunk_id", F.size("terms").cast("long").alias("doc_len"), "terms")


def occurrences(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term), one row for every term of every token.

    Tokens are exploded before they are lower-cased and tested, so that is compiled code and no nested arrays. Only
    what tokens with a boundary emit is appended to a text's tokens; these tokens themselves go after the explosion.
    """
    found = chunks.select("chunk_id", words(F.col("content")).alias("words"))
    # Spark would infer a filter from explode, and split the texts a second time for it.
    found = found.select("chunk_id", F.explode_outer("words").alias("token"))
    found = found.where((F.col("token") != "") & is_whole(F.col("token")))
    return found.select("chunk_id", F.lower("token").alias("term")).where(is_term(F.col("term")))


def with_lengths(counted: DataFrame) -> DataFrame:
    """(chunk_id, term, frequency) of all of a chunk's terms, with their sum as doc_len."""
    length = F.sum("frequency").over(Window.partitionBy("chunk_id"))
    return counted.select("chunk_id", "term", "frequency", length.alias("doc_len"))


def postings(chunks: DataFrame, once: bool = False) -> DataFrame:
    """(chunk_id, term, frequency, doc_len). One shuffle, by chunk, serves the counts and the lengths.

    ``once``, for rows that are written before others read them, shuffles the texts, less than half the bytes of
    their terms; each reader would tokenise again.
    """
    if once:
        found = occurrences(chunks.select("chunk_id", "content").repartition("chunk_id"))
    else:
        found = occurrences(chunks).repartition("chunk_id")
    return with_lengths(found.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("frequency")))


def lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_len) of the chunks with a term; a chunk's rows stand together, so they combine before the shuffle."""
    return occurrences(chunks).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("doc_len"))


@dataclass
class Index:
    """Postings with document lengths, document frequencies and the two corpus figures.

    ``unstored`` are the term occurrences of an index that isn't stored: a search then counts
    its own terms one by one and the others of a chunk together, from one pass over the texts.
    """

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame
    unstored: DataFrame | None = None

    @staticmethod
    def of(posting_rows: DataFrame) -> Index:
        """From stored postings: every chunk with a term counts, chunks without none."""
        found = posting_rows.groupBy("chunk_id").agg(F.first("doc_len").alias("doc_len"))
        return Index(posting_rows, _frequencies(posting_rows), corpus_stats(found))

    @staticmethod
    def build(chunks: DataFrame) -> Index:
        rows = postings(chunks)
        return Index(rows, _frequencies(rows), _stats(rows), occurrences(chunks))

    def of_terms(self, distinct: DataFrame, sent) -> tuple[DataFrame, DataFrame]:
        """The postings of the given terms only, and the corpus figures."""
        if self.unstored is None:
            return self.postings.join(sent(distinct), "term", "left_semi"), self.stats
        asked = sent(distinct.withColumn("asked", F.lit(True)))
        marked = self.unstored.join(asked, "term", "left").select("chunk_id", F.when(F.col("asked"), F.col("term")).alias("term"))
        rows = with_lengths(marked.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("frequency")))
        return rows.where(F.col("term").isNotNull()), _stats(rows)


def _stats(rows: DataFrame) -> DataFrame:
    """The corpus figures of rows that carry their chunk's doc_len."""
    # A chunk's frequencies add up to its length; that reads the same columns as the postings, so Spark reuses their shuffle.
    found = rows.groupBy("chunk_id").agg(F.max("doc_len").alias("doc_len"), F.sum("frequency").alias("sum"))
    return corpus_stats(found.where("sum > 0"))


def _frequencies(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("term").agg(F.count_if(F.col("frequency") > 0).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl) from (chunk_id, doc_len); chunks without a term don't count.

    The condition stands in the aggregates: as a filter it would be tokenised a second time.
    """
    some = F.col("doc_len") > 0
    return lengths.agg(F.count_if(some).alias("n"), F.avg(F.when(some, F.col("doc_len"))).alias("avgdl"))


def doc_lengths(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("chunk_id").agg(F.sum("frequency").alias("doc_len"))


def score_rows(index: Index, wanted: DataFrame, n_terms: int) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk with a wanted term; wanted: (query_id, term)."""

    own, stats = index.of_terms(wanted.select("term").distinct(), lambda df: sent(df, n_terms))
    df = _frequencies(own)
    weighted = wanted.join(df, "term").join(F.broadcast(stats), F.lit(True))  # one row
    weighted = weighted.select("query_id", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    part = F.col("idf") * saturation(F.col("frequency"), F.col("doc_len"), F.col("avgdl"))
    return own.join(sent(weighted, n_terms), "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, limit: int, *ties) -> DataFrame:
    """The best rows of every query with rank; equal scores (to 9 decimals) go by ``ties``."""
    order = [F.round("score", 9).desc(), *(ties or ("chunk_id",))]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= limit)


def normalised(ranked: DataFrame) -> DataFrame:
    """Scores over the query's best; 0 when the best is 0."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.withColumn("best", best).withColumn(
        "score", F.when(F.col("best") == 0, 0.0).otherwise(F.col("score") / F.col("best"))
    ).drop("best")


def search_batch(index: Index, queries: DataFrame, limit: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) for a table of queries (query_id, text).

    ``among`` (chunk_id) filters before the cut; corpus figures stay those of all chunks.
    """
    wanted = query_terms(queries)
    n_terms = wanted.count()
    scored = score_rows(index, wanted, n_terms)
    if among is not None:
        scored = scored.join(among, "chunk_id", "left_semi")
    return normalised(top(scored, limit))


def search(spark: SparkSession, index: Index, query: str, limit: int = 10) -> DataFrame:
    """The same for one query text; its query_id is 0."""
    return search_batch(index, spark.createDataFrame([(0, query)], "query_id long, text string"), limit)


def is_ready(posting_rows: DataFrame) -> bool:
    return not posting_rows.limit(1).isEmpty()
