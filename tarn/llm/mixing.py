"""Mixing sources to target token counts by entropy balancing.

Every document has a rate min(cap, exp(lambda_source * size / mean size of its source)),
the solution of least relative entropy from rate 1 under the source's token constraint. Each source's
lambda solves a one-dimensional convex dual by safeguarded Newton steps, all sources at once:
Spark sums value and slope over the histograms of sizes, which it makes once; no step touches
the documents again. Rates become whole copies by carrying each rounding error to the next
smaller document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import written

#: Share of all words that the mix takes, and the most copies of a document.
MIX_SHARE = 1.5
MAX_COPIES = 2
WEIGHTS = (3, 1, 2)
DOCS_PER_TASK = 4_000
#: So many sources, a row each, are sent to all tasks; more are joined.
FEW_SOURCES = 100_000
#: Newton steps in one Spark job, and jobs at most; a target is met when its relative error is below TOLERANCE.
STEPS, JOBS, TOLERANCE = 4, 20, 1e-7


def n_words(text: str = "text") -> Column:
    """Number of runs of characters that are not a blank, tab, LF, VT, FF or CR (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = MIX_SHARE, cap: float = MAX_COPIES, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights follow the sources' code-point order, null last. Water-filling: sorted by
    source_size / weight, all sources below the level stop at cap * source_size and the rest
    share what is left by weight; the sort and two running sums find the level at once.
    Windows here run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("at", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("double"))
    everything = Window.partitionBy()
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn(
        "all", F.sum("source_size").over(everything) * F.lit(float(share))
    )
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    # The first source that is not full sets the level for itself and all after it.
    at_level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("at"), F.col("level")))).over(
        everything
    )
    ranked = ranked.withColumn("at_level", at_level["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("at_level") * F.col("weight"), F.col("most")))
    return ranked.select("source", "source_size", target.alias("target"))


STATE = ("target", "mean", "tilt", "low", "high", "met")


def _begun(sources: DataFrame, cap: float) -> DataFrame:
    """The state before the first step; sources that take all or nothing have an infinite tilt already."""
    none = (F.col("source_size") <= 0) | (F.col("target") <= 0)
    full = F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")
    tilt = F.when(none, F.lit(-math.inf)).when(full, F.lit(math.inf)).otherwise(F.lit(0.0))
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("source_docs")).otherwise(1.0)
    empty = F.lit(None).cast("double")
    return sources.select(
        F.col("source").alias("s"), "target", mean.alias("mean"), tilt.alias("tilt"), empty.alias("low"),
        empty.alias("high"), (none | full).alias("met"),
    )


def rate_of(cap: float) -> Column:
    """min(cap, exp(tilt * size / mean)); texts of no words have rate 1."""
    expo = F.col("tilt") * F.col("size") / F.col("mean")
    rate = F.when(expo >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(expo))
    return F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0))


def newton_step(hist: DataFrame, state: DataFrame, cap: float, few: bool) -> DataFrame:
    """One step of every source's dual: sum(n * size * rate) = target. ``few``: sources can be sent to all tasks.

    Every source of ``state`` has words, so none gets lost in the join. Sums are of decimals, so they don't depend on the order of rows, and reruns agree.
    """
    joined = hist.where("size > 0").join(F.broadcast(state) if few else state, F.col("s").eqNullSafe(F.col("source")))
    words = F.col("size") * F.col("n") * rate_of(cap)
    free = F.col("tilt") * F.col("size") / F.col("mean") < math.log(cap)
    slope = F.when(free, words * F.col("size") / F.col("mean")).otherwise(0.0)
    # The state goes through the sums, so a step reads the last one once and plans stay short.
    both = joined.groupBy("s").agg(
        F.sum(words.cast("decimal(28,6)")).cast("double").alias("value"),
        F.sum(slope.cast("decimal(28,6)")).cast("double").alias("slope"),
        *[F.first(c).alias(c) for c in STATE],
    )
    short, met = F.col("value") < F.col("target"), F.abs(F.col("value") - F.col("target")) <= TOLERANCE * F.col("target")
    low = F.when(short, F.greatest("low", "tilt")).otherwise(F.col("low"))
    high = F.when(short, F.col("high")).otherwise(F.least("high", "tilt"))
    both = both.withColumns({"low": low, "high": high, "met": F.col("met") | met})
    step = F.when(F.col("slope") > 0, F.col("tilt") - (F.col("value") - F.col("target")) / F.col("slope"))
    reach = F.lit(2.0) * F.greatest(F.lit(1.0), F.abs("tilt"))
    # Without a bound on one side a step goes so far at most; within a bracket it stays or halves it.
    step = F.coalesce(step, F.when(short, F.lit(math.inf)).otherwise(-math.inf))
    step = F.least(F.greatest(step, F.col("tilt") - reach), F.col("tilt") + reach)
    outside = (step <= F.col("low")) | (step >= F.col("high"))
    step = F.when(outside, (F.col("low") + F.col("high")) / 2).otherwise(step)
    return both.withColumn("tilt", F.when(F.col("met"), F.col("tilt")).otherwise(step)).select("s", *STATE)


def tilts(hist: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """(s, tilt, mean, ...) of every source; a few steps make one job, until all targets are met."""
    begun = written(_begun(sources, cap), "mix-tilts")
    few = begun.count() <= FEW_SOURCES
    state = begun.where(~F.col("met"))
    for _ in range(JOBS):
        if state.where(~F.col("met")).isEmpty():
            break
        for _ in range(STEPS):
            state = newton_step(hist, state, cap, few)
        state = written(state, "mix-tilts")
    return begun.where("met").unionByName(state)


def rounded(sizes: list[int], rates: list[float], cap: int) -> list[int]:
    """Whole copies of documents from large to small; each rounding error is carried to the next.

    What the small ones can't take up goes back to the largest that bring the sum nearer.
    """
    carry, copies = 0.0, []
    for size, rate in zip(sizes, rates):
        n = 1 if size == 0 else min(cap, max(0, math.floor(rate + carry / size + 0.5)))
        carry += (rate - n) * size
        copies.append(n)
    for i, size in enumerate(sizes):
        if size and abs(carry) * 2 > size:
            n = min(cap, max(0, copies[i] + math.floor(carry / size + 0.5)))
            carry -= (n - copies[i]) * size
            copies[i] = n
    return copies


def _round_task(cap: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "doc_id", "key"], ascending=[False, True, True], kind="stable", na_position="last")
        block["copies"] = rounded(block["size"].tolist(), block["rate"].tolist(), cap)
        return block[["doc_id", "key", "size", "source", "source_size", "target", "rate", "copies"]]

    return run


def rates(docs: DataFrame, share: float = MIX_SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """(doc_id, key, size, source, source_size, target, rate, copies) of every row of ``docs``.

    ``docs`` needs doc_id, source and text; key is a hash of the text. A text of no words (or
    null) keeps one copy and takes nothing. Copies are whole, so a source misses its target by
    up to half of a document that its smaller ones can't make up for. Rows with a null source
    form a source of their own. Repeated rows are separate documents. A source of no words has
    target 0. An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("key"), n_words().alias("size"))
    sized = written(sized, "mix-sizes")
    hist = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    sources = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs")
    )
    aims = targets(sources.select("source", "source_size"), share, cap).withColumnsRenamed({"source": "a", "source_size": "z"})
    sources = written(sources.join(aims, F.col("a").eqNullSafe(F.col("source"))).drop("a", "z"), "mix-sources")
    blocks = sources.select(
        F.col("source").alias("b"), "source_size", F.ceil(F.col("source_docs") / DOCS_PER_TASK).cast("int").alias("blocks")
    )
    found = tilts(hist, sources, float(cap)).join(blocks, F.col("s").eqNullSafe(F.col("b")))
    found = written(found.select("s", "source_size", "target", "tilt", "mean", "blocks"), "mix-rates")
    few = found.count() <= FEW_SOURCES
    rated = (
        sized.join(F.broadcast(found) if few else found, F.col("s").eqNullSafe(F.col("source")))
        .withColumn("rate", rate_of(cap))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    )
    return rated.groupBy("source", "block").applyInPandas(
        _round_task(cap),
        "doc_id long, key long, size long, source string, source_size long, target double, rate double, copies int",
    )


def mixed(docs: DataFrame, share: float = MIX_SHARE, cap: int = MAX_COPIES) -> DataFrame:
    """The documents of the mix, each as often as it has copies; columns as in ``docs``.

    Repeated rows of one doc_id, source and text are interchangeable: one of them, the first by
    a hash of its columns, takes what they have together.
    """
    found = rates(docs, share, cap)
    names = {"doc_id": "__id", "source": "__source", "size": "__n", "key": "__text"}
    by_id = found.groupBy(*names).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__repeats"))
    by_id = written(by_id.withColumnsRenamed(names), "mix-copies")
    on = F.col("__size") == F.col("__n")
    for have, want in (("doc_id", "__id"), ("source", "__source"), ("__key", "__text")):
        on &= F.col(have).eqNullSafe(F.col(want))
    keyed = docs.withColumns({"__size": n_words(), "__key": F.xxhash64("text")})
    joined = keyed.join(by_id.where("__copies > 0"), on)
    if not by_id.where("__repeats > 1").isEmpty():
        row = F.xxhash64(*[F.col(c) for c in docs.columns])
        at = F.row_number().over(Window.partitionBy("__id", "__source", "__n", "__text").orderBy(row))
        joined = joined.withColumn("__at", at).where("__at = 1")
    again = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return joined.withColumn("__copy", again).select(*docs.columns)


def mix_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return rates(docs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "source",
        "rate",
        "copies",
    )
