"""Block-max postings: a stored index whose search reads only the blocks that can reach the k-th score.

Postings are cut by bucket (a hash of the document), term and tier of impact into blocks of at most
BLOCK, each with its range of chunks, its largest frequency and its least length for a frequency of
one. These two bound the score of everything in the block whatever the corpus figures are, so
blocks stay valid while the corpus changes. The bounds are read without the postings.

A search finds a k-th score in the blocks of highest bounds, a small share of each term. Terms that even together can't reach
it (the non-essential ones) are read only where a candidate of the others stands; of the others,
blocks whose bound with the best of all other terms stays below it aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.scalars import B, K1, idf, saturation
from tarn.functions.tokenize import query_terms
from tarn.operators.lexical import normalised, sent, top
from tarn.sources.scratch import written

BLOCK = 64
#: Tiers by saturation at a fixed chunk length, so many while what it lacks to its greatest halves. Any values give
#: the same results; a length near the average reads least.
REFERENCE_LENGTH, TIERS_A_HALF = 256.0, 3
#: Scores are compared after rounding to 9 decimals.
EPSILON = 1e-8
#: Share of a term's postings, and multiple of the limit, that a search reads at least; steps between the bounds of a term.
FIRST_SHARE, FIRST_LIMITS, STEPS = 0.01, 8, 64
#: An index is built in so many shares of its buckets, one after the other. Any number gives the same rows.
SHARES = 2
KEY = ("bucket", "term", "tier", "block")


def bound(most: Column, spread: Column, avgdl: Column) -> Column:
    """The saturation that no frequency up to ``most`` and no length of ``spread`` a time or more exceeds."""
    return (K1 + 1) / (1 + K1 * (1 - B) / most + K1 * B * spread / avgdl)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def blocks(postings: DataFrame) -> DataFrame:
    """Blocks of postings (bucket, chunk_id, term, frequency, doc_len), in one shuffle by term and bucket.

    Columns: bucket, term, tier, block, low and high chunk_id, n, most (frequency), spread (least
    doc_len over frequency) and the postings, by chunk_id. A term with few postings in a bucket has one tier. Repeated rows
    and rows without frequency go. So a term of every chunk is as many groups as there are buckets.
    """
    rows = postings.where(F.col("frequency") > 0).select("bucket", "chunk_id", "term", "frequency", "doc_len")
    impact = saturation(F.col("frequency"), F.col("doc_len"), F.lit(REFERENCE_LENGTH))
    dealt = rows.repartition("term", "bucket").withColumn("impact", F.floor(-TIERS_A_HALF * F.log2(1 - impact / (K1 + 1))).cast("int"))
    # One sort and one window: a term with one tier has one block, whatever the order; the others' blocks end with a tier.
    of_term = Window.partitionBy("term", "bucket").orderBy("impact", "chunk_id")
    everything = of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = dealt.withColumns({"many": F.count(F.lit(1)).over(everything) > BLOCK, "at": F.row_number().over(of_term)})
    cut = cut.withColumn("tier", F.when(F.col("many"), F.col("impact")).otherwise(0))
    cut = cut.withColumn("block", F.when(F.col("many"), F.floor((F.col("at") - 1) / BLOCK)).otherwise(0).cast("int"))
    found = cut.groupBy("term", "bucket", "tier", "block").agg(
        F.min("chunk_id").alias("low"),
        F.max("chunk_id").alias("high"),
        F.count(F.lit(1)).alias("n"),
        F.max("frequency").alias("most"),
        F.min(F.col("doc_len") / F.col("frequency")).alias("spread"),
        F.sort_array(F.collect_list(F.struct("chunk_id", "frequency", "doc_len"))).alias("postings"),
    )
    return found.select(*KEY, "low", "high", "n", "most", "spread", "postings")


def statistics(postings: DataFrame) -> DataFrame:
    """(bucket, n, terms): chunks with a term and the sum of their lengths; replaced bucket by bucket."""
    chunks = postings.groupBy("bucket", "chunk_id").agg(F.max("doc_len").alias("doc_len"))
    return chunks.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("terms"))


def corpus_figures(stats: DataFrame) -> DataFrame:
    """One row (n, avgdl) from the buckets' rows."""
    return stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("terms") / F.sum("n")).alias("avgdl"))


@dataclass
class BlockIndex:
    """Stored blocks and the statistics of their buckets."""

    blocks: DataFrame
    stats: DataFrame

    @staticmethod
    def of(postings: DataFrame) -> BlockIndex:
        """From postings with buckets, written to the shared folder.

        Some of the buckets at a time: shuffles are several times the blocks they become, and each share's go with it.
        """
        shares = []
        for i in range(SHARES):
            share = F.coalesce(F.pmod("bucket", F.lit(SHARES)), F.lit(0)) == i
            rows = written(postings.where(share), "postings")
            shares.append((written(laid_out(blocks(rows)), "blocks"), written(statistics(rows), "statistics")))
        return BlockIndex(*(reduce(DataFrame.unionByName, tables) for tables in zip(*shares, strict=True)))


def laid_out(rows: DataFrame) -> DataFrame:
    """By term in each file, so that a search's terms are a few row groups."""
    return rows.sortWithinPartitions("term", "bucket", "tier", "block")


@dataclass
class Reading:
    """A search's blocks: ``read`` (query_id, phase, bucket, term, tier, block, n), and its scores of candidates."""

    read: DataFrame
    scored: DataFrame


def reading(index: BlockIndex, queries: DataFrame, limit: int, among: DataFrame | None = None) -> Reading:
    """What a search for ``limit`` chunks reads of the index, and (query_id, chunk_id, score) of all that can be among them.

    Scores are whole for every chunk that reaches the k-th score of its query. ``among`` (chunk_id)
    restricts the chunks that count for it.
    """
    wanted = query_terms(queries)
    n_terms = wanted.count()
    distinct = wanted.select("term").distinct()
    heads = written(index.blocks.drop("postings").join(sent(distinct, n_terms), "term"), "search-heads")
    weights = wanted.join(heads.groupBy("term").agg(F.sum("n").alias("df")), "term").join(F.broadcast(corpus_figures(index.stats)), F.lit(True))
    weights = weights.select("query_id", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    weights = written(weights, "search-terms")
    value = F.col("idf") * bound(F.col("most"), F.col("spread"), F.col("avgdl"))
    heads = written(
        heads.join(sent(weights, n_terms), "term").select("query_id", *KEY, "low", "high", "n", "idf", "avgdl", value.alias("bound")), "search-blocks"
    )

    def holding(asked: DataFrame, chosen: Column) -> DataFrame:
        """The blocks that any row (query_id, term, idf, avgdl and more) of ``asked`` chooses, once each, with their postings."""
        rows = index.blocks.select("bucket", "term", "most", "spread", "postings")
        return rows.join(sent(asked, n_terms).withColumnRenamed("term", "t"), (F.col("term") == F.col("t")) & chosen, "left_semi")

    def opened(rows: DataFrame) -> DataFrame:
        """(bucket, term, chunk_id, frequency, doc_len): the postings of blocks."""
        return rows.select("bucket", "term", F.explode("postings").alias("p")).select("bucket", "term", "p.*")

    part = F.col("idf") * saturation(F.col("frequency"), F.col("doc_len"), F.col("avgdl"))

    def summed(rows: DataFrame, asked: DataFrame, kept: Column | None = None) -> DataFrame:
        """(query_id, bucket, chunk_id, part): what blocks give to the queries that ask for their terms, one more than chose them too.

        A posting is shuffled once, by chunk, however many queries ask for it.
        """
        found = opened(rows).repartition("chunk_id").join(sent(asked, n_terms), "term").withColumn("part", part)
        found = found if kept is None else found.where(kept)
        return found.groupBy("query_id", "bucket", "chunk_id").agg(F.sum("part").alias("part"))

    def standing(candidates: DataFrame, of: DataFrame, also: Column | None = None) -> DataFrame:
        """The blocks ``of`` in whose range a candidate (query_id, bucket, chunk_id, part) stands."""
        c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in ("query_id", "bucket", "chunk_id", "part")])
        inside = (F.col("query_id") == F.col("c_query_id")) & (F.col("bucket") == F.col("c_bucket"))
        inside &= F.col("c_chunk_id").between(F.col("low"), F.col("high"))
        return of.join(c, inside if also is None else inside & also, "left_semi")

    # First: of each term the blocks of highest bounds, by steps, until there are enough postings.
    bounds = heads.groupBy("query_id", "term").agg(F.max("bound").alias("top"), F.sum("n").alias("df"))
    step = F.floor(value / F.col("top") * STEPS)
    stepped = heads.join(sent(bounds, n_terms), ["query_id", "term"])
    stepped = stepped.withColumn("step", F.floor(F.col("bound") / F.col("top") * STEPS))
    steps = stepped.groupBy("query_id", "term", "step").agg(F.sum("n").alias("n"), F.first("df").alias("df"), F.first("top").alias("top"))
    above = Window.partitionBy("query_id", "term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    enough = F.greatest(F.col("df") * FIRST_SHARE, F.lit(FIRST_LIMITS * limit))
    steps = steps.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("above") < enough)
    cut = steps.groupBy("query_id", "term").agg(F.min("step").alias("cut"), F.first("top").alias("top"))
    cut = written(cut.join(sent(weights, n_terms), ["query_id", "term"]), "search-cuts")
    first = stepped.join(sent(cut.select("query_id", "term", "cut"), n_terms), ["query_id", "term"]).where(F.col("step") >= F.col("cut"))
    seeds = summed(holding(cut, step >= F.col("cut")), cut).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("part"))
    if among is not None:
        seeds = seeds.join(among, "chunk_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
    least = seeds.withColumn("rank", rank).where(F.col("rank") == limit).select("query_id", (F.col("part") - EPSILON).alias("least"))
    # Then: terms from the least bound on are non-essential as long as all of them together stay below.
    of_query = Window.partitionBy("query_id")
    together = F.sum("top").over(of_query.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))
    terms = cut.join(least, "query_id", "left").select(
        "query_id",
        "term",
        "idf",
        "avgdl",
        F.coalesce("least", F.lit(float("-inf"))).alias("least"),
        (F.sum("top").over(of_query) - F.col("top")).alias("others"),
        F.when(together < F.col("least"), F.col("top")).alias("spared"),
    )
    terms = terms.withColumn("rest", F.coalesce(F.sum("spared").over(of_query), F.lit(0.0)))
    terms = written(terms, "search-bounds")
    known = heads.join(sent(terms.drop("idf", "avgdl"), n_terms), ["query_id", "term"])
    essential = known.where(F.col("spared").isNull() & (F.col("bound") + F.col("others") >= F.col("least")))
    needed, spare = terms.where(F.col("spared").isNull()), terms.where(F.col("spared").isNotNull())
    reaches = F.col("part") + F.col("others") >= F.col("least")
    found = summed(holding(needed, value + F.col("others") >= F.col("least")), needed, reaches)
    limits = terms.groupBy("query_id").agg(F.first("least").alias("least"), F.first("rest").alias("rest"))
    candidates = found.join(sent(limits, n_terms), "query_id").where(F.col("part") + F.col("rest") >= F.col("least"))
    candidates = written(candidates.select("query_id", "bucket", "chunk_id", "part"), "search-candidates")
    # A chunk's own block of a non-essential term isn't below what the chunk lacks.
    spared = known.where(F.col("spared").isNotNull()).withColumn("gap", F.col("least") - F.col("rest") + F.col("spared") - F.col("bound"))
    rest = standing(candidates, spared, F.col("c_part") >= F.col("gap"))
    also = written(rest.select(*KEY).distinct(), "search-rest")
    more = index.blocks.select(*KEY, "postings").join(sent(spare.select("term").distinct(), n_terms), "term", "left_semi")
    more = opened(more.join(also, list(KEY), "left_semi")).drop("bucket")
    # Postings and candidates meet by chunk; a candidate's row has no term, so it stays one.
    own = candidates.select(F.col("query_id").alias("own"), "chunk_id", F.col("part").alias("own_part"))
    rows = more.unionByName(own, allowMissingColumns=True).repartition("chunk_id")
    rows = rows.join(sent(spare.select("query_id", "term", "idf", "avgdl"), n_terms), "term", "left")
    rows = rows.select(F.coalesce("own", "query_id").alias("query_id"), "chunk_id", "own", F.coalesce("own_part", part).alias("part"))
    scored = rows.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.count("own").alias("own")).where("own > 0").drop("own")
    if among is not None:
        scored = scored.join(among, "chunk_id", "left_semi")
    shown = ["query_id", *KEY, "n"]
    read = first.select(*shown).unionByName(essential.select(*shown)).unionByName(rest.select(*shown))
    return Reading(read.distinct(), scored)


def search_batch(index: BlockIndex, queries: DataFrame, limit: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank), as a search over all postings gives them.

    ``among`` (chunk_id) filters before the cut; corpus figures stay those of all chunks.
    """
    return normalised(top(reading(index, queries, limit, among).scored, limit))


def search(spark: SparkSession, index: BlockIndex, query: str, limit: int = 10) -> DataFrame:
    return search_batch(index, spark.createDataFrame([(0, query)], "query_id long, text string"), limit)
