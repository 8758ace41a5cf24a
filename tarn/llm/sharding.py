"""Byte-balanced sharding by Karmarkar-Karp differencing.

Copies of a text travel together. Groups are dealt to tasks, each task differences its own
groups into one partial partition of ``n_shards`` byte sums, and the partial partitions (one
short vector per task) are differenced again, level by level, so the largest spreads always
meet oppositely ordered.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import text_digest, written

#: Groups per differencing task, and rows per numbering task, that are aimed at.
GROUPS_PER_TASK = 20_000
#: Partial partitions that one task, or at last the driver, differences.
FAN_IN = 4_096
ROWS_PER_BLOCK = 50_000


def difference(parts: list[tuple[int, ...]], n_shards: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions.

    ``parts`` are vectors of at most ``n_shards`` sums; returns for each the shard of each
    of its positions. Combining takes the two of largest spread, one ascending and one
    descending. Ties go to the earlier position, so reruns agree.
    """
    if not parts:
        return []
    nodes: list = []  # (sums descending, children or None, how each child's positions map)
    heap = []
    for i, sums in enumerate(parts):
        padded = list(sums) + [0] * (n_shards - len(sums))
        order = sorted(range(n_shards), key=padded.__getitem__, reverse=True)
        ranked = [padded[j] for j in order]
        nodes.append((None, order))
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        joined = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(n_shards), key=joined.__getitem__, reverse=True)
        ranked = [joined[j] for j in order]
        nodes.append(((left, right), order))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    shard_of: list = [None] * len(nodes)
    shard_of[-1] = list(range(n_shards))
    for k in range(len(nodes) - 1, -1, -1):
        children, order = nodes[k]
        mine = [0] * n_shards  # of this node's unsorted positions
        for rank, position in enumerate(order):
            mine[position] = shard_of[k][rank]
        if children is None:
            shard_of[k] = mine
        else:
            shard_of[children[0]] = mine
            shard_of[children[1]] = mine[::-1]
            shard_of[k] = None
    return shard_of[: len(parts)]


def _difference_task(n_shards: int):
    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["gkey", "piece"], kind="stable")
        found = difference([(int(x),) for x in groups["bytes"]], n_shards)
        groups["part"] = [x[0] for x in found]
        return groups[["gkey", "piece", "bucket", "part", "bytes"]]

    return run


def _merge_task(n_shards: int):
    """Differences the partial partitions of the buckets below one bucket of the next level."""

    def run(sums: pd.DataFrame) -> pd.DataFrame:
        sums = sums.sort_values(["bucket", "part"], kind="stable")
        at = {b: i for i, b in enumerate(sums["bucket"].unique())}
        vectors = [[0] * n_shards for _ in at]
        for bucket, part, size in zip(sums["bucket"], sums["part"], sums["bytes"]):
            vectors[at[bucket]][part] = int(size)
        found = difference([tuple(v) for v in vectors], n_shards)
        sums["up_part"] = [found[at[b]][p] for b, p in zip(sums["bucket"], sums["part"])]
        return sums[["bucket", "part", "up", "up_part", "bytes"]]

    return run


def _merged(parts: DataFrame, n_buckets: int, n_shards: int) -> DataFrame:
    """(bucket, part, shard) of the partial partitions of ``parts`` (bucket, part, bytes)."""
    spark = parts.sparkSession
    sums = parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    if n_buckets > FAN_IN:
        above = -(-n_buckets // FAN_IN)
        joined = sums.withColumn("up", F.pmod("bucket", F.lit(above)).cast("int")).groupBy("up").applyInPandas(
            _merge_task(n_shards), "bucket int, part int, up int, up_part int, bytes long"
        )
        joined = written(joined, "shard-merged")
        top = _merged(joined.select(F.col("up").alias("bucket"), F.col("up_part").alias("part"), "bytes"), above, n_shards)
        top = top.select(F.col("bucket").alias("up"), F.col("part").alias("up_part"), "shard")
        return joined.join(top, ["up", "up_part"]).select("bucket", "part", "shard")
    # At most FAN_IN * n_shards rows, whatever the input.
    by_bucket: dict[int, list[int]] = {}
    for r in sums.collect():
        by_bucket.setdefault(r["bucket"], [0] * n_shards)[r["part"]] = r["bytes"]
    order = sorted(by_bucket)
    found = difference([tuple(by_bucket[b]) for b in order], n_shards)
    final = [(b, p, s) for b, shards in zip(order, found) for p, s in enumerate(shards)]
    return F.broadcast(spark.createDataFrame(final, "bucket int, part int, shard int"))


def balanced_shards(docs: DataFrame, n_shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with size, text_crc32, shard and slot.

    Size is the UTF-8 bytes of the text plus 1 (null: 1). Copies of a text stay in one
    shard, unless they weigh more than a fair share, which no shard could balance: such a group
    (there are fewer than n_shards) is cut into pieces of about an eighth of a share. Nulls form a group;
    their CRC is that of no bytes, 0. Repeated rows each get a slot. Slots run from 0 in each
    shard without gaps, by (key block, key, row). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        size.alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(text_digest(text), F.lit(b"")).alias("gkey"),
    )
    # Numbered in a written table: each file comes from one attempt, so the numbers don't change any more.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "shard-groups")
    total = groups.agg(F.sum("bytes"), F.count(F.lit(1)), F.sum("n")).first()
    total_bytes, n_groups, n_rows = (int(x or 0) for x in total)
    share = max(1, total_bytes // n_shards)
    # Fewer than n_shards groups can weigh over a share, so this side is bounded.
    is_heavy = (F.col("bytes") > share) & (F.col("n") > 1)
    heavy = F.broadcast(
        groups.where(is_heavy).select(
            "gkey", F.least(F.col("n"), F.ceil(F.col("bytes") * 8 / share)).cast("long").alias("pieces")
        )
    )
    # By row, not by id: rows that share an id, or have none, can be parted too.
    piece = F.coalesce(F.pmod(F.col("row"), F.col("pieces")), F.lit(0)).alias("piece")
    cut = (
        rows.join(heavy, "gkey")
        .select("gkey", piece, "size")
        .groupBy("gkey", "piece")
        .agg(F.sum("size").alias("bytes"))
    )
    whole = groups.where(~is_heavy).select("gkey", F.lit(0).cast("long").alias("piece"), "bytes")
    n_buckets = max(1, -(-n_groups // GROUPS_PER_TASK))
    bucket = F.pmod(F.xxhash64("gkey", "piece", F.lit(7)), F.lit(n_buckets)).cast("int")
    parts = (
        whole.unionByName(cut)
        .withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandas(
            _difference_task(n_shards), "gkey binary, piece long, bucket int, part int, bytes long"
        )
    )
    parts = written(parts, "shard-parts")
    final = _merged(parts.select("bucket", "part", "bytes"), n_buckets, n_shards)
    placed = parts.join(final, ["bucket", "part"]).select("gkey", "piece", "shard")
    # A group's rows can be many; its placement is one row, and skewed joins are split at run time.
    sharded = (
        rows.join(heavy, "gkey", "left")
        .select("doc_id", "size", "text_crc32", "gkey", piece)
        .join(placed, ["gkey", "piece"])
        .select("doc_id", "size", "text_crc32", "shard")
    )
    return numbered(sharded, n_rows, n_shards)


def numbered(rows: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Gapless slots by shard: blocks of keys are numbered apart, then shifted by the blocks before."""
    n_blocks = max(1, -(-n_rows // (n_shards * ROWS_PER_BLOCK)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    rows = written(rows, "shard-placed")
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(
        Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("shift"))
    at = F.row_number().over(
        Window.partitionBy("shard", "block").orderBy(F.col("doc_id").asc_nulls_last(), "size", "text_crc32")
    )
    return (
        rows.withColumn("at", at)
        .join(F.broadcast(shifts) if n_blocks * n_shards <= 100_000 else shifts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("at") - 1 + F.col("shift")).cast("long").alias("slot"))
    )


def shard_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return balanced_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
