"""Exact vector search, pending embeddings and the readiness check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.scalars import embedding_text
from tarn.operators.lexical import top

#: Query vectors go to the tasks in blocks of about so many values (32 MB of doubles), or one vector.
BLOCK_VALUES = 4_000_000
#: Stored values a task is given where the table has fewer than all tasks could take.
TASK_VALUES = 250_000
#: Queries x rows of one product, and values of its rows (8 MB of doubles each).
CELLS = 1 << 20
ROWS = 1024


class DimensionMismatch(ValueError):
    """Stored vectors don't have the configured number of dimensions."""


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the n + 1 bounds of its rows; nulls count as zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    values = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return values, bounds.astype(np.int64)


def _cosines(queries: np.ndarray, column: pa.Array) -> np.ndarray:
    """Cosine of every query with every row, in double precision; 0 for other lengths and zero vectors."""
    values, bounds = _rows(column)
    out = np.zeros((len(queries), len(column)))
    same = np.flatnonzero(np.diff(bounds) == queries.shape[1])
    x = values[bounds[same][:, None] + np.arange(queries.shape[1])]
    size_q, size_x = np.sqrt((queries**2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
    scale = size_q[:, None] * size_x[None, :]
    out[:, same] = np.divide(queries @ x.T, scale, out=np.zeros_like(scale), where=scale > 0)
    return out


class _Best:
    """Running best rows of one block of queries; rows come by chunk_id, so earlier ones win ties."""

    def __init__(self, limit: int):
        self.limit = limit
        self.asked: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        self.state: list[tuple] | None = None
        self.kind = None

    def ask(self, ids: pa.Array, column: pa.Array) -> None:
        values, bounds = _rows(column)
        sizes = np.diff(bounds)
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            self.asked.setdefault(int(d), []).append((ids.take(pa.array(rows)), values[bounds[rows][:, None] + np.arange(d)]))

    def see(self, ids: pa.Array, column: pa.Array) -> None:
        if self.state is None:
            self.state, self.kind = [], ids.type
            for found in self.asked.values():
                vectors = np.concatenate([v for _, v in found])
                empty = np.full((len(vectors), self.limit), -np.inf)
                names = np.full(empty.shape, None, object)
                self.state.append((pa.concat_arrays([i for i, _ in found]), vectors, empty, empty.copy(), names))
            self.asked = {}
        fresh = np.array([*ids.to_pylist(), None], object)[:-1]
        for _, vectors, shown, score, names in self.state:
            rows = max(1, min(ROWS, CELLS // max(1, vectors.shape[1])))
            step = max(1, CELLS // (rows + self.limit))
            for x in range(0, len(column), rows):
                for q in range(0, len(vectors), step):
                    own = slice(q, q + step)
                    self._merge(shown[own], score[own], names[own], _cosines(vectors[own], column[x : x + rows]), fresh[x : x + rows])

    def _merge(self, shown, score, names, new, fresh) -> None:
        """The best of the rows so far and ``new`` (queries x rows), in place."""
        k = self.limit
        seen = np.where(np.isnan(new), -np.inf, np.round(new, 9))
        better = np.flatnonzero((seen > shown[:, -1:]).any(axis=1))
        if len(better) == 0:
            return
        both = np.concatenate((shown[better], seen[better]), axis=1)
        least = -np.partition(-both, k - 1, axis=1)[:, k - 1]
        q, c = np.nonzero(both >= least[:, None])
        order = np.lexsort((c, -both[q, c], q))
        q, c = q[order], c[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        q, c, at = q[at < k], c[at < k], at[at < k]
        to, old = better[q], c < k
        kept_score, kept_name = np.empty(len(q)), np.empty(len(q), object)
        kept_score[old], kept_name[old] = score[to[old], c[old]], names[to[old], c[old]]
        kept_score[~old], kept_name[~old] = new[to[~old], c[~old] - k], fresh[c[~old] - k]
        shown[to, at], score[to, at], names[to, at] = both[q, c], kept_score, kept_name

    def rows(self) -> Iterator[pa.RecordBatch]:
        for ids, _, shown, score, names in self.state or ():
            for at in range(0, len(shown), 10_000):
                q, slot = np.nonzero(np.isfinite(shown[at : at + 10_000]))
                q += at
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(q)), pa.array(names[q, slot].tolist(), self.kind), pa.array(score[q, slot], pa.float64())],
                    names=["query_id", "chunk_id", "score"],
                )


def search_batch(embeddings: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): every stored vector scored against every query vector.

    ``queries`` has (query_id, vector). Blocks of queries meet slots of stored rows in tasks: a
    task holds one block and its best rows, and streams a slot past it, sorted by chunk_id, in
    products of bounded size. Nothing but two counts comes to the driver.
    """
    spark = embeddings.sparkSession
    kinds = {f.name: f.dataType for f in queries.schema.fields} | {"chunk_id": embeddings.schema["chunk_id"].dataType}
    schema = T.StructType(
        [
            T.StructField("query_id", kinds["query_id"]),
            T.StructField("chunk_id", kinds["chunk_id"]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    asked = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    stored = embeddings.select("chunk_id", F.col("embedding").alias("vector"))
    size = asked.agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    if not size[0] or limit < 1:
        return top(spark.createDataFrame([], schema), limit)
    values = stored.agg(F.sum(F.greatest(F.size("vector"), F.lit(1)))).first()[0] or 0
    blocks = max(1, -(-(size[1] or 0) // BLOCK_VALUES))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, -(-values // BLOCK_VALUES), min(tasks, -(-values // TASK_VALUES)))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int, *of: str):
        return F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")

    left = asked.select(
        dealt(blocks, "query_id").alias("block"), each(slots).alias("slot"), F.lit(0).alias("side"),
        "query_id", F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"), "vector",
    )
    right = stored.select(
        each(blocks).alias("block"), dealt(slots, "chunk_id").alias("slot"), F.lit(1).alias("side"),
        F.lit(None).cast(kinds["query_id"]).alias("query_id"), "chunk_id", "vector",
    )
    met = left.unionByName(right).repartition(blocks * slots, "block", "slot")
    met = met.sortWithinPartitions("block", "slot", "side", "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                block, slot, side = marks[:, low].tolist()
                if key != (block, slot):
                    if best is not None:
                        yield from best.rows()
                    best, key = _Best(limit), (block, slot)
                part = batch.slice(low, high - low)
                if side:
                    best.see(part.column("chunk_id"), part.column("vector"))
                else:
                    best.ask(part.column("query_id"), part.column("vector"))
        if best is not None:
            yield from best.rows()

    return top(met.mapInArrow(run, schema), limit)


def pending(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without a vector, oldest first."""
    return chunks.join(embeddings, "chunk_id", "left_anti").orderBy("created_at", "chunk_id")


def embedding_texts(chunks: DataFrame, with_breadcrumb: bool = True) -> DataFrame:
    m = F.col("metadata")
    own = [F.col(c) for c in ("language", "chunk_type", "name", "content")]
    text = embedding_text(*own, m["signature"], m["docstring"], m["parentName"])
    if with_breadcrumb:
        text = F.concat_ws("\n", "breadcrumb", text)
    return chunks.select("chunk_id", text.alias("text"))


def readiness(postings: DataFrame, embeddings: DataFrame, edges: DataFrame, dimensions: int) -> DataFrame:
    """(strategy, ready): whether each strategy has what it needs; vectors must be of ``dimensions``.

    One row of each table at most is looked at.
    """

    def found(strategy: str, rows: DataFrame, good: Column) -> DataFrame:
        ready = F.coalesce(F.min(good), F.lit(False))
        return rows.limit(1).agg(ready.alias("ready")).select(F.lit(strategy).alias("strategy"), "ready")

    lexical = found("bm25", postings, F.lit(True))
    vectors = found("vector", embeddings, F.coalesce(F.size("embedding") == dimensions, F.lit(False)))
    both = lexical.unionByName(vectors).agg(F.min("ready").alias("ready")).select(F.lit("hybrid").alias("strategy"), "ready")
    return lexical.unionByName(vectors).unionByName(both).unionByName(found("graph", edges.where("resolved"), F.lit(True)))


def check_ready(embeddings: DataFrame, dimensions: int) -> bool:
    """False without vectors; raises DimensionMismatch when they have another length."""
    first = embeddings.select(F.size("embedding").alias("d")).limit(1).collect()
    if not first:
        return False
    if first[0]["d"] != dimensions:
        raise DimensionMismatch(f"stored vectors have {first[0]['d']} dimensions, {dimensions} are configured")
    return True
