"""What a stored index and its searches put on disk beside their results."""

from pyspark.sql import functions as F

from tarn.operators import blocks, lexical
from tarn.sources.scratch import written


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _shuffled(spark):
    """Bytes that shuffles have written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def _texts(spark, n=3000):
    words = [F.concat(F.lit(w), (F.xxhash64("id", F.lit(w)) % 40).cast("string")) for w in ("alpha", "beta", "gamma", "delta")]
    return spark.range(n).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("common"), *words).alias("content"))


def _postings(spark):
    return lexical.postings(_texts(spark), once=True).withColumn("bucket", blocks.bucket_of(F.col("chunk_id"), 4))


def test_written_tables_leave_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = _shuffle_files(spark), spark.conf.get(setting, None)
    rows = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not _shuffle_files(spark) - before and spark.conf.get(setting, None) == set_to
    assert rows.count() == 7


def test_index_and_search_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    index = blocks.BlockIndex.of(_postings(spark))
    read = blocks.reading(index, spark.createDataFrame([(0, "common alpha1 beta2")], "query_id long, text string"), 10)
    assert not _shuffle_files(spark) - before
    assert read.scored.count() >= 10


def test_postings_are_shuffled_once_for_all_queries(spark):
    """Forty queries of the same terms ask for forty times as many scores, but not for other postings."""
    index = blocks.BlockIndex.of(_postings(spark))
    took, found = [], []
    for n in (1, 40):
        asked = spark.createDataFrame([(i, "common alpha1 beta2 gamma3 delta4") for i in range(n)], "query_id long, text string")
        before = _shuffled(spark)
        found.append(blocks.search_batch(index, asked, 10).where("query_id = 0").orderBy("rank").collect())
        took.append(_shuffled(spark) - before)
    assert found[0] == found[1] and len(found[0]) == 10
    assert took[1] < 4 * took[0]


def test_texts_are_shuffled_instead_of_their_terms(spark):
    texts, plain = written(_texts(spark), "texts"), []
    for once in (False, True):
        before = _shuffled(spark)
        plain.append(sorted(map(tuple, lexical.postings(texts, once=once).collect())))
        plain.append(_shuffled(spark) - before)
    assert plain[0] == plain[2] and 0 < plain[3] < plain[1]


def test_shares_give_the_same_index(spark, monkeypatch):
    rows = written(_postings(spark), "postings")
    monkeypatch.setattr(blocks, "SHARES", 1)
    one = blocks.BlockIndex.of(rows)
    monkeypatch.setattr(blocks, "SHARES", 3)
    three = blocks.BlockIndex.of(rows)
    for a, b in ((one.blocks, three.blocks), (one.stats, three.stats)):
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_occurrences_are_the_terms(spark):
    """Tokens without a boundary are lower-cased apart from those with one; the sum is the same."""
    texts = [None, "", "getHTTPResponse2Go fooBar foo_bar x1Y 12 123a", "ΑΣ.ΑΒ ΑΣ' İstanbul étatÉtat ǅabc", "!fooBar", "the tHe BARfoo parseURLFast 9Z9 9z"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    plain = lexical.term_rows(chunks).select("chunk_id", F.explode("terms").alias("term"))
    assert sorted(map(tuple, lexical.occurrences(chunks).collect())) == sorted(map(tuple, plain.collect())) != []


def test_texts_are_split_once(spark):
    plan = lexical.postings(_texts(spark), once=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") > 0 and "Filter (size(" not in plan and "size(CASE" not in plan
