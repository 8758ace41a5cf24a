"""Exact top-k inner-product search with two cover trees.

Vectors are dealt to blocks around a bounded set of pivots (the trees' top level). Every block
is one packed row holding a cover tree of its vectors and one of its query vectors. A pair of
nodes is skipped when no inner product between the two balls can reach the worst k-th score of
the queries below the query node:

    <cq, cr> + rq * |cr| + rr * |cq| + rq * rr  <  worst k-th score

Each query block first meets its own block, which sets its k-th scores; then only block pairs
that may still matter are formed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import written

LEAF = 256
FAN_OUT = 32
#: Reference vectors that a query leaf is compared with at once.
STEP = 2_048
#: Radius of a child relative to its parent's.
SHRINK = 1.6
ROWS_PER_BLOCK = 8192
#: Blocks grow beyond ROWS_PER_BLOCK rather than exceed this number, so what is sent to
#: all tasks (one centre, radius and key a block) stays below some 20 MB for 64 dimensions.
MOST_BLOCKS = 20_000
MOST_PIVOTS = 4_096
#: Query blocks that meet a reference block in one task.
SLICE = 32


class CoverTree:
    """A cover tree over the rows of ``x``: nested balls with measured radii.

    Children's centres are a net: each new one is the farthest point from those before, until
    all points are within 1/SHRINK of the parent's radius or FAN_OUT centres stand. Either way
    the two laws of a cover tree hold with the covering radius that is left: every point is so
    near to its centre, and centres are at least so far apart.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray | None] = []
        if len(x):
            middle = x.mean(axis=0)
            root = int(np.argmin(((x - middle) ** 2).sum(axis=1)))
            self._grow(np.arange(len(x)), root)
        self.norm = np.sqrt((x[self.centre] ** 2).sum(axis=1)) if self.centre else np.empty(0)

    def _distances(self, at: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.x[at] - self.x[centre]) ** 2).sum(axis=1))

    def _node(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.members.append(None)
        return len(self.centre) - 1

    def _grow(self, points: np.ndarray, centre: int) -> None:
        todo = [(points, centre, None)]
        while todo:
            at, c, parent = todo.pop()
            d = self._distances(at, c)
            node = self._node(c, float(d.max()))
            if parent is not None:
                self.children[parent].append(node)
            if len(at) <= LEAF or self.radius[node] == 0:
                self.members[node] = np.sort(at)
                continue
            scale = self.radius[node] / SHRINK
            centres, nearest, owner = [c], d.copy(), np.zeros(len(at), np.int64)
            while len(centres) < FAN_OUT and nearest.max() > scale:
                far = int(np.argmax(nearest))
                e = self._distances(at, int(at[far]))
                closer = e < nearest
                owner[closer] = len(centres)
                nearest[closer] = e[closer]
                centres.append(int(at[far]))
            if np.bincount(owner).max() == len(at):
                self.members[node] = np.sort(at)
                continue
            for k, mine in enumerate(centres):
                if len(chosen := at[owner == k]):
                    todo.append((chosen, mine, node))


class Search:
    """Dual traversal of one query tree and one reference tree, keeping each query's k best."""

    def __init__(self, queries: CoverTree, refs: CoverTree, k: int, worst: np.ndarray):
        self.q, self.r, self.k = queries, refs, k
        self.score = np.full((len(queries.x), k), -np.inf)
        self.index = np.full((len(queries.x), k), len(refs.x), np.int64)
        self.worst = worst.copy()
        most = max((np.abs(t.x).max(initial=0) ** 2 * t.x.shape[1] for t in (queries, refs)), default=0)
        kind = np.float32 if most < 2**24 else np.float64  # both exact: scores are sums of whole numbers
        self.qx, self.rx = queries.x.astype(kind), refs.x.astype(kind)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query leaf, reference leaf, bound) of the leaf pairs that may matter, descending both trees together."""
        q, r = self.q, self.r
        least = np.empty(len(q.centre))
        for node in range(len(q.centre) - 1, -1, -1):
            mine = q.members[node]
            least[node] = self.worst[mine].min() if mine is not None else least[q.children[node]].min()
        q_leaf = np.array([m is not None for m in q.members])
        r_leaf = np.array([m is not None for m in r.members])
        q_centre, r_centre = q.x[q.centre], r.x[r.centre]
        q_radius, r_radius = np.array(q.radius), np.array(r.radius)
        done = []
        a, b = np.array([0]), np.array([0])
        while len(a):
            most = (q_centre[a] * r_centre[b]).sum(axis=1)
            most += q_radius[a] * r.norm[b] + r_radius[b] * q.norm[a] + q_radius[a] * r_radius[b]
            # Scores are whole numbers: a bound within rounding of the worst still counts.
            live = most >= least[a] - 1e-6 * (1 + np.abs(most))
            a, b, most = a[live], b[live], most[live]
            end = q_leaf[a] & r_leaf[b]
            done.append((a[end], b[end], most[end]))
            a, b = a[~end], b[~end]
            by_r = ~r_leaf[b] & (q_leaf[a] | (r_radius[b] >= q_radius[a]))
            next_a = [np.repeat(x, len(r.children[y])) for x, y in zip(a[by_r], b[by_r])]
            next_b = [np.array(r.children[y]) for y in b[by_r]]
            next_a += [np.array(q.children[x]) for x in a[~by_r]]
            next_b += [np.repeat(y, len(q.children[x])) for x, y in zip(a[~by_r], b[~by_r])]
            a, b = (np.concatenate(x) if x else np.empty(0, int) for x in (next_a, next_b))
        return tuple(np.concatenate(x) for x in zip(*done))

    def run(self) -> Search:
        if not self.q.centre or not self.r.centre:
            return self
        a, b, most = self.pairs()
        for leaf in np.unique(a):
            mine, here = self.q.members[leaf], np.flatnonzero(a == leaf)
            here = here[np.argsort(-most[here], kind="stable")]
            at = 0
            while at < len(here) and most[here[at]] >= self.worst[mine].min() - 1e-6 * (1 + abs(most[here[at]])):
                theirs, size = [], 0
                while at < len(here) and size < STEP:
                    theirs.append(self.r.members[b[here[at]]])
                    size += len(theirs[-1])
                    at += 1
                self._compare(mine, np.concatenate(theirs))
        return self

    def _compare(self, mine: np.ndarray, theirs: np.ndarray) -> None:
        got = self.qx[mine] @ self.rx[theirs].T
        hit = got >= self.worst[mine][:, None]
        rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        if len(rows) == 0:
            return
        mine, theirs, got = mine[rows], theirs[columns], got[np.ix_(rows, columns)].astype(np.float64)
        if len(columns) > 8 * self.k:
            # More than k columns of a row can't all be among its k best; equal scores all stay.
            cut = -np.partition(-got, self.k - 1, axis=1)[:, self.k - 1]
            columns = np.flatnonzero((got >= np.maximum(cut, self.worst[mine])[:, None]).any(axis=0))
            theirs, got = theirs[columns], got[:, columns]
        score = np.concatenate([self.score[mine], got], axis=1)
        index = np.concatenate([self.index[mine], np.broadcast_to(theirs, got.shape)], axis=1)
        best = np.lexsort((index, -score), axis=1)[:, : self.k]
        self.score[mine] = np.take_along_axis(score, best, 1)
        self.index[mine] = np.take_along_axis(index, best, 1)
        self.worst[mine] = np.maximum(self.worst[mine], self.score[mine, -1])


def _pack(matrix: np.ndarray) -> bytes:
    """A cover tree over ``matrix`` with its vectors in the smallest whole type."""
    tree = CoverTree(matrix)
    most = np.abs(matrix).max(initial=0)
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    return pickle.dumps((matrix.astype(kind), tree.centre, tree.radius, tree.children, tree.members, tree.norm))


def _unpack(blob: bytes) -> CoverTree:
    tree = CoverTree.__new__(CoverTree)
    x, tree.centre, tree.radius, tree.children, tree.members, tree.norm = pickle.loads(blob)
    tree.x = x.astype(np.float64)
    return tree


def _as_matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed_block(dim: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        x = _as_matrix(rows["v"].to_list(), dim)
        keys = rows["key"].to_numpy()
        asked = rows["asked"].to_numpy(bool)
        middle = x.mean(axis=0)
        radius = float(np.sqrt(((x - middle) ** 2).sum(axis=1)).max())
        out = {
            "block": int(rows["block"].iloc[0]),
            "n_asked": int(asked.sum()),
            "centre": middle.tolist(),
            "radius": radius,
            "refs": pickle.dumps((keys, _pack(x), [list(map(int, i)) for i in rows["ids"]])),
            "queries": pickle.dumps((keys[asked], _pack(x[asked]))),
        }
        return pd.DataFrame([out])

    return run


_trees: dict[bytes, tuple] = {}


def _tree(blob: bytes):
    """The unpacked block and its tree; a worker keeps the last few, as pairs come sorted."""
    if blob not in _trees:
        if len(_trees) >= 4:
            _trees.clear()
        keys, packed, *ids = pickle.loads(blob)
        _trees[blob] = (keys, _unpack(packed), ids[0] if ids else None)
    return _trees[blob]


def _found(q_keys, r_keys, r_ids, search: Search) -> pd.DataFrame:
    """Each query vector's best reference vectors, with all their ids; same marks the query's own vector."""
    q, slot = np.nonzero(np.isfinite(search.score) & (search.index < len(r_ids)))
    at = search.index[q, slot]
    return pd.DataFrame(
        {
            "key": q_keys[q],
            "score": search.score[q, slot].astype(np.int64),
            "same": r_keys[at] == q_keys[q],
            "ids": pd.Series([r_ids[i] for i in at], dtype=object),
        }
    )


FOUND = "key long, score long, same boolean, ids array<long>"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows by integer inner product.

    ``vectors`` has an id and an array<long> of whole components; ``queries`` has the ids that
    are asked. Null ids, null arrays and arrays with null take no part; shorter arrays count as
    padded with zeros. Rows are rows: those that share an id each ask, and each is a candidate
    for all but itself. Ties go to smaller ids; a query with fewer others gets them all. Equal
    vectors are indexed once with their k + 1 smallest ids (repeats kept), which are all that any
    result can hold. Components must keep inner products below 2**53.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull())
    )
    asked = queries.select(F.col(id_col).alias("id")).distinct().withColumn("asked", F.lit(True))
    rows = clean.join(asked, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    # Numbers of a written table: each file comes from one attempt, so they don't change any more.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.select("v", "id", first.alias("at")).where(F.col("at") <= k + 1)
    ids = kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    any_asked = rows.groupBy("v").agg(F.max("asked").alias("asked"))
    distinct = ids.join(any_asked, "v").select("v", "ids", "asked").withColumn("key", F.monotonically_increasing_id())
    distinct = written(distinct.select("key", "v", "ids", "asked"), "topk-distinct")
    size = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, dim = int(size[0]), int(size[1] or 0)
    if n == 0 or dim == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = _blocks(distinct, n, dim)
    # One row a block: at most MOST_BLOCKS + MOST_PIVOTS, whatever the input.
    heads = blocks.select("block", "centre", "radius").collect()
    head = spark.sparkContext.broadcast(
        (
            np.array([r["block"] for r in heads]),
            np.array([r["centre"] for r in heads]),
            np.array([r["radius"] for r in heads]),
        )
    )
    want = k + 1

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, refs, queries in zip(batch["block"], batch["refs"], batch["queries"]):
                q_keys, q_tree, _ = _tree(queries)
                r_keys, r_tree, r_ids = _tree(refs)
                search = Search(q_tree, r_tree, want, np.full(len(q_keys), -np.inf)).run()
                found = _found(q_keys, r_keys, r_ids, search)
                yield pd.DataFrame(
                    {
                        "block": [int(block)],
                        "queries": [queries],
                        "worst": [pickle.dumps(search.worst)],
                        "found": [pickle.dumps(found)],
                    }
                )

    at_home = blocks.where("n_asked > 0").select("block", "refs", "queries").mapInPandas(
        home, "block long, queries binary, worst binary, found binary"
    )
    at_home = written(at_home, "topk-home")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["found"]:
                yield pickle.loads(blob)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, centre, radius = head.value
        norm = np.sqrt((centre**2).sum(axis=1))
        for batch in batches:
            for own, queries, worst in zip(batch["block"], batch["queries"], batch["worst"]):
                keys, tree, _ = _tree(queries)
                least = pickle.loads(worst)
                keep = np.zeros(len(block), bool)
                for node in range(len(tree.centre)):
                    if tree.members[node] is None:
                        continue
                    c, r = tree.x[tree.centre[node]], tree.radius[node]
                    most = centre @ c + r * norm + radius * tree.norm[node] + r * radius
                    keep |= most >= least[tree.members[node]].min() - 1e-6 * (1 + np.abs(most))
                keep &= block != own
                yield pd.DataFrame({"own": int(own), "block": block[keep]})

    near = at_home.select("block", "queries", "worst").mapInPandas(pairs, "own long, block long")
    near = written(near, "topk-pairs")
    # A reference block goes once to each slice of SLICE query blocks that it meets, not once to each.
    slices = near.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    slices = F.broadcast(slices)  # one row a block, of a bounded number
    asking = (
        near.join(slices, "block")
        .withColumn("slice", F.pmod(F.xxhash64("own"), F.col("slices")).cast("int"))
        .join(at_home.select(F.col("block").alias("own"), "queries", "worst"), "own")
    )
    answering = blocks.select("block", "refs").join(slices, "block").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )

    def away(asking: pd.DataFrame, answering: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(answering) and len(asking):
            r_keys, r_tree, r_ids = _tree(answering["refs"].iloc[0])
            for own, queries, worst in sorted(zip(asking["own"], asking["queries"], asking["worst"])):
                q_keys, q_tree, _ = _tree(queries)
                least = pickle.loads(worst)
                search = Search(q_tree, r_tree, want, least).run()
                # What lies below the home block's k-th score can't be among the best.
                search.score[search.score < least[:, None]] = -np.inf
                out.append(_found(q_keys, r_keys, r_ids, search))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "score": [], "same": [], "ids": []})

    met = asking.select("block", "slice", "own", "queries", "worst").groupBy("block", "slice")
    met = met.cogroup(answering.select("block", "slice", "refs").groupBy("block", "slice")).applyInPandas(away, FOUND)
    found = at_home.select("found").mapInPandas(unpack, FOUND).unionByName(met)
    flat = found.select("key", "score", "same", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", F.desc("same")))
    flat = flat.withColumn("at", best).where(F.col("at") <= want).drop("at")
    of = rows.where("asked").join(distinct.where("asked").select("v", "key"), "v").select(
        "row", F.col("id").alias("query_id"), "key"
    )
    # Of the entries with the query's own id and vector, one is the query itself.
    own = F.col("same") & (F.col("vec_id") == F.col("query_id"))
    order = [F.desc("score"), F.col("vec_id"), F.desc("own")]
    nth = F.row_number().over(Window.partitionBy("row", "own").orderBy(*order[:2]))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return (
        of.join(flat, "key")
        .withColumn("own", own)
        .withColumn("nth", nth)
        .where(~F.col("own") | (F.col("nth") > 1))
        .withColumn("rank", rank.cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _blocks(distinct: DataFrame, n: int, dim: int) -> DataFrame:
    """Packed blocks around a bounded sample of pivots; large cells are cut by a hash of the key."""
    spark = distinct.sparkSession
    n_pivots = int(min(MOST_PIVOTS, max(1, n // 4096)))
    picked = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()
    pivots = spark.sparkContext.broadcast(_as_matrix([r["v"] for r in picked], dim))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pivots.value
        half = (p**2).sum(axis=1) / 2
        for batch in batches:
            if len(batch):
                x = _as_matrix(batch["v"].to_list(), dim)
                batch["cell"] = np.argmax(x @ p.T - half, axis=1)
                yield batch

    placed = distinct.mapInPandas(place, "key long, v array<long>, ids array<long>, asked boolean, cell long")
    placed = written(placed, "topk-placed")
    rows_a_block = max(ROWS_PER_BLOCK, -(-n // MOST_BLOCKS))
    cells = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows_a_block).cast("long").alias("cuts"))
    block = F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("v"), F.col("cuts"))
    dealt = placed.join(F.broadcast(cells), "cell").select("key", "v", "ids", "asked", block.alias("block"))
    packed = dealt.groupBy("block").applyInPandas(
        _packed_block(dim),
        "block long, n_asked long, centre array<double>, radius double, refs binary, queries binary",
    )
    return written(packed, "topk-blocks")


def whole_components(column: str = "embedding"):
    """floor(64 * x) of every component as longs; null where a component is null or not finite."""
    bad = F.exists(
        column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * 64))
    return F.when(F.col(column).isNotNull() & ~bad, whole)


def top_k_query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", whole_components().alias("v")
    )
    queries = vectors.where(F.pmod("vec_id", F.lit(20)) == 0).select("vec_id")
    return top_k(vectors, queries, 20)


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.r AS row, q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score
  FROM v q JOIN v r ON q.r <> r.r WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
