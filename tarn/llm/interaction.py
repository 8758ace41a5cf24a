"""Filter interaction audit: what each filter removes at each step of every order of the filters.

A document fails a set of filters (its mask). In an order, the first filter of its mask removes
it. The orders that begin with the same letters are neighbours in the list of all orders, so
where a mask is removed at a step is a handful of intervals of Lehmer ranks. Documents are
counted by mask once; each count is added where an interval begins and taken off where it ends,
and prefix sums over the ranks give every order's totals. No document meets an order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import text_digest

LETTERS = "ABCDE"
#: Orders grow with the factorial; the tables of orders and intervals are sent to all tasks.
MOST_FILTERS = 6
BLANKS = r"[\x20\x09-\x0D]+"


def intervals(filters: int, mask: int) -> Iterator[tuple[int, int, int]]:
    """(step, begin, end): at which step, in which ranks of orders, the first filter of ``mask`` stands.

    The k-th of the filters that are left begins the k-th block of as many ranks as the others have orders.
    """

    def walk(left: tuple[int, ...], step: int, begin: int) -> Iterator[tuple[int, int, int]]:
        size = math.factorial(len(left) - 1)
        for k, f in enumerate(left):
            at = begin + k * size
            if mask >> f & 1:
                yield step, at, at + size
            elif len(left) > 1:
                yield from walk(left[:k] + left[k + 1 :], step + 1, at)

    return walk(tuple(range(filters)), 1, 0)


def _edges(spark: SparkSession, filters: int) -> DataFrame:
    """(mask, step, rank, sign): both ends of all intervals; the empty mask adds 0 to every place."""
    ranks = math.factorial(filters)
    rows = [(0, step, rank, 0) for step in range(1, filters + 1) for rank in range(ranks)]
    for mask in range(1, 1 << filters):
        for step, begin, end in intervals(filters, mask):
            rows.append((mask, step, begin, 1))
            if end < ranks:
                rows.append((mask, step, end, -1))
    return spark.createDataFrame(rows, "mask int, step int, rank int, sign long")


def _orders(spark: SparkSession, letters: str) -> DataFrame:
    """(rank, step, filter, filter_order) of all orders, by rank."""
    rows = []
    for rank, order in enumerate(itertools.permutations(range(len(letters)))):
        name = "".join(letters[f] for f in order)
        rows += [(rank, step + 1, f, name) for step, f in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, step int, filter int, filter_order string")


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for every part, order and step, from (part, mask, n, good, toxic) counts of documents.

    Bit k of a mask is the filter of letter k. ``kept`` after the step, ``removed`` in it,
    ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing no other filter),
    ``good_lost`` and ``toxic_lost`` of the removed, ``shapley`` (removed by its filter, over all
    orders). Repeated cells add up; a part without documents has no row.
    """
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    spark, filters = cells.sparkSession, range(len(letters))

    def bits(hit) -> Column:
        return F.array(*[F.sum(F.when(hit(k), F.col("n")).otherwise(0)) for k in filters])

    cells = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # At most 2 ** len(letters) entries a part.
    counts = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    parts = cells.groupBy("part").agg(
        F.sum("n").alias("total"),
        bits(lambda k: F.col("mask").bitwiseAND(1 << k) > 0).alias("fails"),
        bits(lambda k: F.col("mask") == 1 << k).alias("unique"),
        counts.alias("counts"),
    )
    masks = parts.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))))
    here = masks.withColumn("count", F.try_element_at("counts", F.col("mask"))).drop("counts")
    changes = here.join(F.broadcast(_edges(spark, len(letters))), "mask")
    changed = changes.groupBy("part", "step", "rank").agg(
        *[F.first(c).alias(c) for c in ("total", "fails", "unique")],
        *[F.sum(F.col("sign") * F.coalesce(f"count.{c}", F.lit(0))).alias(c) for c in ("n", "good", "toxic")],
    )
    # Windows of as many rows as there are orders, or steps.
    to_here = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = changed.withColumns({c: F.sum(c).over(to_here) for c in ("n", "good", "toxic")})
    so_far = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    named = summed.withColumn("kept", F.col("total") - so_far).join(F.broadcast(_orders(spark, letters)), ["rank", "step"])
    return named.select(
        "part",
        "filter_order",
        "step",
        "kept",
        F.col("n").alias("removed"),
        (F.element_at("fails", F.col("filter") + 1) - F.col("n")).alias("redundant"),
        F.element_at("unique", F.col("filter") + 1).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def text_filters(text: Column, few: int = 200, distinct: int = 50, capitals: int = 3) -> list[Column]:
    """The filters A to D: whether a text fails by few words, repeated words, capitals, symbols."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    shouted = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < few,
        100 * kinds.cast("long") < distinct * n.cast("long"),
        100 * shouted.cast("long") > capitals * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, and how many are labelled good or toxic.

    A null text is empty, a null lang the part ''. The last filter is failed by a text that a
    smaller doc_id has too: a text's rows of the least doc_id don't fail it, nor do rows without
    doc_id, which aren't compared. Repeated rows count each. A document is good (toxic) if any of
    its labels says so. Of a text's copies, only counts by part and label and the least ids move.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    mask = sum(f.cast("int") * (1 << k) for k, f in enumerate(text_filters(F.col("text"))))
    rows = docs.select("doc_id", "part", mask.alias("mask"), text_digest().alias("digest"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.join(marks, "doc_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("good", "toxic")}
    )
    same = ["digest", "part", "mask", "good", "toxic"]
    ids = known.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    groups = ids.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed"),
    )
    # A window holds a text's parts and labels, not its copies.
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    spared = groups.withColumn("least", least).withColumn("spared", F.col("unnamed") + first)
    copy = 1 << LETTERS.index("E")
    split = F.explode(
        F.array(
            F.struct(F.col("mask"), F.col("spared").alias("n")),
            F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("spared")).alias("n")),
        )
    )
    cells = spared.select("part", "good", "toxic", split.alias("cell")).where("cell.n > 0")
    n = F.col("cell.n")
    return cells.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def interaction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions(failures(docs, labels))


#: The same by trying every order on every mask.
INTERACTION_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
failed AS (
  SELECT doc_id, part,
         concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS x FROM orders, range(1, 6) t(s)),
gone AS (
  SELECT filter_order, fails, min(step) AS step
  FROM steps, (SELECT DISTINCT fails FROM cells) WHERE contains(fails, x) GROUP BY filter_order, fails),
tried AS (
  SELECT c.part, s.filter_order, s.step, s.x,
         sum(CASE WHEN g.step IS NULL OR g.step > s.step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN g.step = s.step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(c.fails, s.x) AND g.step < s.step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN c.fails = s.x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN g.step = s.step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN g.step = s.step THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells c CROSS JOIN steps s LEFT JOIN gone g ON g.filter_order = s.filter_order AND g.fails = c.fails
  GROUP BY c.part, s.filter_order, s.step, s.x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM tried
"""
