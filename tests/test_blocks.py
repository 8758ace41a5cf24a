"""Block-max postings against a search that reads every posting."""

import pytest
from pyspark.sql import functions as F

from tarn.operators import blocks, lexical


def _postings(spark, chunks, buckets=4):
    """Postings of made-up chunks: a term of most chunks, two of some, a rare one, and long and short chunks."""
    rows = spark.range(chunks).select(F.col("id").alias("chunk_id"))

    def draw(n, seed):
        return F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(n))

    def times(seed):
        """One more with half the probability each."""
        return (F.lit(20) - F.floor(F.log2(draw(1 << 20, seed) + 1))).cast("long")

    doc_len = (F.pow(F.lit(2.0), (draw(300, 1) + draw(300, 11) + draw(300, 12)) / 100) * 20).cast("long")
    drawn = {
        "most": F.when(draw(10, 2) < 8, times(3)),
        "some": F.when(draw(10, 4) < 3, times(5)),
        "other": F.when(draw(10, 6) < 2, times(7)),
        "rare": F.when(draw(1000, 8) < 2, times(9)),
    }
    some = [F.struct(F.lit(t).alias("term"), n.alias("frequency")) for t, n in drawn.items()]
    some.append(F.struct(F.concat(F.lit("own"), draw(50, 10).cast("string")).alias("term"), F.lit(1).cast("long").alias("frequency")))
    found = rows.select("chunk_id", doc_len.alias("doc_len"), F.explode(F.array(*some)).alias("t")).where("t.frequency > 0")
    found = found.select(blocks.bucket_of(F.col("chunk_id"), buckets).alias("bucket"), "chunk_id", "t.term", "t.frequency", "doc_len")
    return found


@pytest.fixture(scope="module")
def postings(spark):
    return _postings(spark, 40_000).persist()


@pytest.fixture(scope="module")
def index(spark, postings):
    return blocks.BlockIndex.of(postings)


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())


def _queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_blocks_hold_all_postings(postings, index):
    rows = index.blocks
    back = rows.select("bucket", "term", F.explode("postings").alias("p")).select("bucket", "p.chunk_id", "term", "p.frequency", "p.doc_len")
    assert back.exceptAll(postings.select(back.columns)).count() == 0 and back.count() == postings.count()
    assert rows.where(F.col("n") > blocks.BLOCK).count() == 0 and rows.where(F.col("n") != F.size("postings")).count() == 0
    inside = F.forall("postings", lambda p: p["chunk_id"].between(F.col("low"), F.col("high")) & (p["frequency"] <= F.col("most")) & (p["doc_len"] / p["frequency"] >= F.col("spread")))
    assert rows.where(~inside).count() == 0
    figures, plain = blocks.corpus_figures(index.stats).first(), lexical.Index.of(postings).stats.first()
    assert figures["n"] == plain["n"] and figures["avgdl"] == pytest.approx(plain["avgdl"])


def test_same_rows_as_all_postings(spark, postings, index):
    asked = _queries(spark, "most rare", "most some", "some other most", "most", "rare nothing", "nothing", "", "own7 own8 rare most", None)
    plain = lexical.Index.of(postings)
    for limit in (1, 10, 200):
        assert _rows(blocks.search_batch(index, asked, limit)) == _rows(lexical.search_batch(plain, asked, limit))
    among = spark.range(0, 40_000, 7).select(F.col("id").alias("chunk_id"))
    assert _rows(blocks.search_batch(index, asked, 10, among)) == _rows(lexical.search_batch(plain, asked, 10, among))


def test_reads_a_small_share(spark):
    """The share falls as lists grow, as the best chunks stay as few: under a tenth of the long list and the rare one here."""
    large = _postings(spark, 300_000)
    index = blocks.BlockIndex.of(large)
    asked = _queries(spark, "most rare", "most some")
    read = {r["query_id"]: r["n"] for r in blocks.reading(index, asked, 10).read.groupBy("query_id").agg(F.sum("n").alias("n")).collect()}
    df = {r["term"]: r["n"] for r in large.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 0 < read[0] < 0.1 * (df["most"] + df["rare"]) and 0 < read[1] < 0.2 * (df["most"] + df["some"])


def test_odd_tables(spark, postings):
    none = blocks.BlockIndex.of(postings.limit(0))
    assert blocks.search(spark, none, "most rare").count() == 0
    few = spark.createDataFrame(
        [(0, "b", "xx", 2, 9), (0, "b", "xx", 2, 9), (0, "a", "xx", 2, 9), (1, "c", "yy", 0, 4), (1, "d", None, 1, 4)],
        "bucket int, chunk_id string, term string, frequency long, doc_len long",
    )
    got = blocks.search(spark, blocks.BlockIndex.of(few.dropDuplicates()), "xx yy").collect()
    assert [(r["chunk_id"], r["rank"]) for r in got] == [("a", 1), ("b", 2)]
