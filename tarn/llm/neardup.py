"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Every shingle throws hashed darts: a Poisson process of arrival times in each unit strip of
its weight, each dart hitting one signature coordinate. A document keeps the earliest dart of
each coordinate, so a coordinate agrees between two documents with the probability of their
weighted Jaccard similarity. Bands of coordinates make buckets; links inside buckets are
verified on the whole shingle sets, and classes are the connected components of the links.

No large bucket is expanded into its pairs. First each member meets its bucket's most connected
member; what is then still outside a bucket's largest component is compared with all in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import (
    BASE, U64, bounded_batches, byte_view, counted, mix64, numbered_copies, pieces, shingles, text_digest, unit, words, written,
)

WIDTH = 5
SIMILARITY = 0.8
#: 24 bands of 4 rows miss a pair of similarity 0.8 with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: Pairs whose signatures agree in fewer coordinates aren't verified: six standard deviations below 0.8.
LEAST_AGREEMENT = 0.55
CHUNK_BYTES = 1 << 20
#: Digests that a task remembers, so that it doesn't repeat the work on copies that stand near.
SEEN = 10_000
#: Buckets up to this size are compared by a join, larger ones block by block.
SMALL_BUCKET = 32
BLOCK = 512
#: Columns of a block's 0/1 matrices.
VOCABULARY = 4_096
#: Keys up to this number (8 MB) are sent to the tasks, so that texts needn't shuffle; more are joined.
SENT_KEYS = 1_000_000


def dart_signatures(
    elements: np.ndarray, owner: np.ndarray, rows: int, t: int = COORDINATES, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, filled): uint64[rows, t] of the earliest dart per coordinate; filled: rows with elements.

    ``elements`` are hashes, ``owner`` their rows, ``weights`` positive (default 1). A repeated
    unweighted element throws the same darts again and changes nothing. Darts later than a
    row's horizon are not thrown; a row with an empty coordinate gets a doubled horizon, which
    leaves its earliest darts as they are.
    """
    signature = np.zeros((rows, t), U64)
    if weights is not None:
        strips = np.maximum(1, np.ceil(weights)).astype(np.int64)
        which = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
        elements = mix64(np.repeat(elements, strips) + which.astype(U64) * U64(BASE))
        part = np.minimum(np.repeat(weights, strips) - which, 1.0)
        owner = np.repeat(owner, strips)
    else:
        part = None
    total = np.bincount(owner, weights=part, minlength=rows)
    filled = total > 0
    horizon = np.where(filled, (t * np.log(t) + 2 * t) / np.maximum(total, 1e-9), 0.0)
    todo = filled.copy()
    while todo.any():
        earliest = np.full(rows * t, np.inf)
        winner = np.zeros(rows * t, U64)
        live = np.flatnonzero(todo[owner])
        base = mix64(elements[live])
        cell, limit = owner[live] * t, horizon[owner[live]]
        share = None if part is None else part[live]
        time = np.zeros(len(live))
        darts = []
        k = 0
        while len(base):
            k += 1
            h = mix64(base + U64(k * 0xD1342543DE82EF95 % (1 << 64)))
            time = time - np.log(unit(h))
            keep = time < limit
            base, cell, limit, time, h = base[keep], cell[keep], limit[keep], time[keep], h[keep]
            dart = mix64(h ^ U64(0xA5A5A5A5A5A5A5A5))
            at = cell + (dart % U64(t)).astype(np.int64)
            if share is not None:
                share = share[keep]
                inside = unit(mix64(dart)) <= share
                darts.append((at[inside], time[inside], dart[inside]))
            else:
                darts.append((at, time, dart))
        at, when, dart = (np.concatenate(x) for x in zip(*darts)) if darts else (np.empty(0, int),) * 3
        np.minimum.at(earliest, at, when)
        first = when == earliest[at]
        winner[at[first]] = dart[first]
        complete = todo & np.isfinite(earliest.reshape(rows, t)).all(axis=1)
        signature[complete] = winner.reshape(rows, t)[complete]
        todo &= ~complete
        horizon = horizon * 2
    return signature, filled


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(signature), bands), U64)
    grouped = signature.reshape(len(signature), bands, rows)
    for k in range(rows):
        out = mix64(out * U64(BASE) + grouped[:, :, k])
    return mix64(out + np.arange(bands, dtype=U64)).view(np.int64)


def _fresh(batch: pa.RecordBatch, seen: dict[bytes, None]) -> pa.RecordBatch:
    """The rows whose digest this task hasn't met among its last SEEN ones."""
    keep = []
    for i, digest in enumerate(batch.column("digest").to_pylist()):
        if digest not in seen:
            seen[digest] = None
            keep.append(i)
            if len(seen) > SEEN:
                del seen[next(iter(seen))]
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def _shingled(batches: Iterator[pa.RecordBatch]):
    """Per slice of texts that are new to the task: the slice, distinct shingles, their rows and counts."""
    seen: dict[bytes, None] = {}
    for piece in pieces(batches, "text", CHUNK_BYTES):
        piece = _fresh(piece, seen)
        if piece.num_rows:
            hashes, _, _, bounds = words(*byte_view(piece.column("text")))
            yield piece, *counted(*shingles(hashes, bounds, WIDTH))


def _sign(by_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found, owner, counts in _shingled(batches):
            weights = counts.astype(np.float64) if by_count else None
            signature, filled = dart_signatures(found, owner, piece.num_rows, weights=weights)
            bands = band_keys(signature)
            keep = np.flatnonzero(filled)
            small = (signature[keep] & U64(0xFFFFFFFF)).astype(np.uint32)
            offsets = pa.array(np.arange(len(keep) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("digest").take(pa.array(keep)),
                    pa.array([s.tobytes() for s in small], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(bands[keep].ravel())),
                ],
                names=["digest", "signature", "bands"],
            )

    return run


def _sets(by_count: bool):
    """The distinct shingle hashes of every text; by count, one for each time a shingle stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found, owner, counts in _shingled(batches):
            if by_count:
                found, which = numbered_copies(found, counts)
                owner = owner[which]
            order = np.argsort(owner, kind="stable")
            found, owner = found[order], owner[order]
            offsets = np.searchsorted(owner, np.arange(piece.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("digest"),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int64))),
                ],
                names=["digest", "shingles"],
            )

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, class_id) of every node of the links (a, b): the least node it is connected to.

    Labels spread along links and then jump to their label's label, so the rounds grow with
    the logarithm of a chain's length. Every round is written; nothing is collected.
    """
    edges = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "dup-edges",
    )
    labels = written(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("class_id")
        ),
        "dup-labels",
    )
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "class_id"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("class_id").alias("m"))
        spread = labels.join(near, "node").select(
            "node", F.col("class_id").alias("was"), F.least("class_id", "m").alias("class_id")
        )
        up = spread.select(F.col("node").alias("class_id"), F.col("class_id").alias("up"))
        after = written(
            spread.join(up, "class_id").select("node", "was", F.least("class_id", "up").alias("class_id")),
            "dup-labels",
        )
        moved = after.where(F.col("class_id") != F.col("was")).limit(1).count()
        labels = after.select("node", "class_id")
        if not moved:
            return labels


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose signatures agree in enough coordinates."""
    for batch in batches:
        if len(batch):
            x = np.frombuffer(b"".join(batch["sa"]), np.uint32).reshape(len(batch), -1)
            y = np.frombuffer(b"".join(batch["sb"]), np.uint32).reshape(len(batch), -1)
            yield batch.loc[(x == y).mean(axis=1) >= LEAST_AGREEMENT, ["a", "b"]]


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each of ``y``, by products of 0/1 matrices."""

    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (a, row_a), (b, row_b) = flat(x), flat(y)
    both = np.intersect1d(a, b)
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(both), VOCABULARY):
        part = both[at : at + VOCABULARY]
        sides = []
        for values, rows, n in ((a, row_a, len(x)), (b, row_b, len(y))):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            m = np.zeros((n, len(part)), np.float32)
            m[rows[hit], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _blockwise(similarity: float):
    """Verified links between two blocks of one bucket, from rows that stand together by block pair.

    ``side`` 0 holds members outside the bucket's largest component, side 1 any members. A
    member gets one link to each component it is similar to; more would not join more.
    """
    names = ["bucket", "i", "j"]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group[group["side"] == 0], group[group["side"] == 1]
        if one.empty or two.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x = np.frombuffer(b"".join(one["signature"]), np.uint32).reshape(len(one), -1)
        y = np.frombuffer(b"".join(two["signature"]), np.uint32).reshape(len(two), -1)
        same = np.zeros((len(one), len(two)), np.int16)
        for k in range(x.shape[1]):
            same += x[:, k][:, None] == y[:, k][None, :]
        class_y = two["class_id"].to_numpy()
        likely = (one["class_id"].to_numpy()[:, None] != class_y[None, :]) & (same >= LEAST_AGREEMENT * x.shape[1])
        at_x, at_y = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        if len(at_x) == 0:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets_x = [np.asarray(one["shingles"].iloc[i]) for i in at_x]
        sets_y = [np.asarray(two["shingles"].iloc[j]) for j in at_y]
        both = _shared(sets_x, sets_y)
        n_x, n_y = np.array([len(s) for s in sets_x]), np.array([len(s) for s in sets_y])
        linked = likely[np.ix_(at_x, at_y)] & (both >= similarity * (n_x[:, None] + n_y[None, :] - both))
        i, j = np.nonzero(linked)
        a, b = one["node"].to_numpy()[at_x[i]], two["node"].to_numpy()[at_y[j]]
        found = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "own": a, "other": class_y[at_y[j]]})
        return found.drop_duplicates(["own", "other"])[["a", "b"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            if len(rest) == 0:
                continue
            open_ = (rest[names] == rest[names].iloc[-1]).all(axis=1)
            for _, group in rest[~open_].groupby(names, sort=False):
                yield solve(group)
            rest = rest[open_]
        if rest is not None and len(rest):
            yield solve(rest)

    return run


def sent_if_few(keys: DataFrame) -> DataFrame:
    """Written keys, marked for a broadcast join if they are counted to be few, else for a sorted one."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys.hint("merge")


class NearDuplicates:
    """The stages of one run over ``docs`` (doc_id, text).

    Nodes are distinct texts, known by their digest; rows that share a doc_id are one document,
    so their texts are linked. ``by_count`` weighs a shingle by how often it stands in a text
    (similarity: sum of lesser over sum of greater counts), else all weigh the same.
    """

    def __init__(self, docs: DataFrame, similarity: float = SIMILARITY, by_count: bool = True):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest().alias("digest"))
        self.texts = bounded_batches(rows.where(F.col("text").isNotNull()).select("digest", "text"))
        self.ids = written(rows.select("doc_id", "digest"), "dup-ids")
        self.similarity, self.by_count = similarity, by_count

    def verified(self, pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) at or above the similarity: signatures first, then whole sets."""
        one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
        two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
        likely = written(pairs.join(one, "a").join(two, "b").mapInPandas(_agreeing, "a long, b long"), "dup-likely")
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        enough = both >= F.lit(self.similarity) * (F.size("x") + F.size("y") - both)
        return likely.join(y, "b").join(x, "a").where(enough).select("a", "b")

    def labels(self) -> DataFrame:
        """(node, class_id) of the nodes that have a link; ``self.copies`` holds all distinct texts."""
        copies = self.ids.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"))
        # Numbers of a written table: each file comes from one attempt, so they don't change any more.
        self.copies = copies = written(copies.withColumn("node", F.monotonically_increasing_id()), "dup-copies")
        signed = self.texts.mapInArrow(_sign(self.by_count), "digest binary, signature binary, bands array<long>")
        signed = signed.groupBy("digest").agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        nodes = signed.join(copies, "digest").select("node", "digest", "signature", "bands")
        nodes = written(nodes, "dup-nodes")
        rows = nodes.select("node", F.explode("bands").alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        sizes = written(sizes, "dup-sizes")
        # Written sides and sorted joins, here and below: Spark can split the rows of a hot bucket.
        shared = written(rows.join(sizes.hint("merge"), "bucket"), "dup-shared")
        popular = shared.groupBy("node").agg(F.sum("size").alias("popular"))
        likely = nodes.join(popular, "node").select("node", "digest", "signature", "popular")
        likely = written(likely, "dup-candidates")
        sets = written(self.sets(likely), "dup-sets")
        # Each member meets its bucket's most connected member: as many pairs as bucket rows, at most.
        ranked = shared.join(likely.select("node", "popular"), "node")
        centre = ranked.groupBy("bucket").agg(F.max(F.struct("popular", -F.col("node"))).alias("most"))
        centre = written(centre.select("bucket", (-F.col("most.col2")).alias("centre")), "dup-centres")
        pairs = (
            shared.join(centre.hint("merge"), "bucket")
            .where(F.col("node") != F.col("centre"))
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
            .distinct()
        )
        links = written(self.verified(pairs, likely, sets).unionByName(self.same_document()), "dup-links")
        labels = components(links)
        apart = self.left_apart(shared, labels)
        more = self.verified(self.small_buckets(apart), likely, sets).unionByName(self.large_buckets(apart, likely, sets))
        more = written(more, "dup-more")
        return labels if more.isEmpty() else components(links.unionByName(more))

    def sets(self, likely: DataFrame) -> DataFrame:
        """(node, shingles) of the candidates; the 64-bit keys only thin the texts out before the join by digest."""
        keys = written(likely.select(F.xxhash64("digest").alias("key")).distinct(), "dup-keys")
        texts = self.texts.join(sent_if_few(keys), F.xxhash64("digest") == F.col("key"), "left_semi")
        sets = texts.mapInArrow(_sets(self.by_count), "digest binary, shingles array<long>")
        sets = sets.groupBy("digest").agg(F.first("shingles").alias("shingles"))
        return sets.join(likely.select("digest", "node"), "digest").select("node", "shingles")

    def same_document(self) -> DataFrame:
        """Links (a, b) between the texts of rows that share a doc_id."""
        known = self.ids.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
        heads = known.groupBy("doc_id").agg(F.min("digest").alias("head"), F.max("digest").alias("last"))
        heads = written(heads.where(F.col("head") != F.col("last")).select("doc_id", "head"), "dup-heads")
        pairs = known.join(heads.hint("merge"), "doc_id").where(F.col("digest") != F.col("head"))
        number = self.copies.select("digest", "node")
        pairs = pairs.select("digest", "head").distinct().join(number.withColumnRenamed("node", "x"), "digest")
        pairs = pairs.join(number.select(F.col("digest").alias("head"), F.col("node").alias("y")), "head")
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def classes(self) -> DataFrame:
        """(doc_id, digest, class_id, head) of every row of ``docs``.

        class_id is the least doc_id of the class, null if it has none; head is the least digest
        of such a nameless class, and null in others.
        """
        labels = self.labels()
        linked = self.copies.join(labels, "node").select("digest", "first", F.col("class_id").alias("class"))
        names = linked.groupBy("class").agg(F.min("first").alias("class_id"), F.min("digest").alias("least"))
        named = linked.join(names, "class").select(F.col("digest").alias("d"), F.col("class_id").alias("named"), "least")
        texts = self.copies.join(written(named, "dup-named"), F.col("digest") == F.col("d"), "left").select(
            "digest",
            F.when(F.col("d").isNull(), F.col("first")).otherwise(F.col("named")).alias("class_id"),
            F.coalesce("least", "digest").alias("head"),
        )
        texts = texts.withColumn("head", F.when(F.col("class_id").isNull(), F.col("head")))
        found = written(self.ids.join(written(texts, "dup-texts").hint("merge"), "digest", "left"), "dup-found")
        missing = F.col("digest").isNull()
        if found.where(missing).isEmpty():
            return found.select("doc_id", "digest", "class_id", "head")
        # A null text goes with the other rows of its doc_id, if there are any.
        others = found.where(~missing & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
            F.min("class_id").alias("other")
        )
        nulls = found.where(missing).join(others, F.col("doc_id") == F.col("id"), "left").select(
            "doc_id", "digest", F.coalesce("other", "doc_id").alias("class_id"), "head"
        )
        return found.where(~missing).select("doc_id", "digest", "class_id", "head").unionByName(nulls)

    def left_apart(self, shared: DataFrame, labels: DataFrame) -> DataFrame:
        """(bucket, node, size, class_id, lead) of the buckets with several components; lead is the largest."""
        rows = shared.join(labels, "node", "left").select(
            "bucket", "node", "size", F.coalesce("class_id", "node").alias("class_id")
        )
        rows = written(rows, "dup-labelled")
        parts = rows.groupBy("bucket", "class_id").agg(F.count(F.lit(1)).alias("n"))
        lead = parts.groupBy("bucket").agg(
            F.max_by("class_id", F.struct("n", "class_id")).alias("lead"), F.count(F.lit(1)).alias("parts")
        )
        lead = written(lead.where("parts > 1").drop("parts"), "dup-leads")
        return written(rows.join(lead.hint("merge"), "bucket"), "dup-apart")

    def small_buckets(self, apart: DataFrame) -> DataFrame:
        """The pairs of different components in buckets of at most SMALL_BUCKET rows."""
        small = apart.where(F.col("size") <= SMALL_BUCKET)
        x = small.select("bucket", F.col("node").alias("a"), F.col("class_id").alias("ca"))
        y = small.select("bucket", F.col("node").alias("b"), F.col("class_id").alias("cb"))
        pairs = x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
        return pairs.select("a", "b").distinct()

    def large_buckets(self, apart: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Verified links of larger buckets: members outside the lead component against all, in blocks."""
        large = apart.where(F.col("size") > SMALL_BUCKET)
        outside = F.col("class_id") != F.col("lead")
        counts = large.groupBy("bucket").agg(F.ceil(F.count_if(outside) / BLOCK).cast("int").alias("n_i"))
        large = large.join(counts, "bucket").withColumn("n_j", F.ceil(F.col("size") / BLOCK).cast("int"))
        full = nodes.select("node", "signature").join(sets, "node")
        large = large.join(full, "node")
        kept = ["bucket", "i", "j", "side", "node", "class_id", "signature", "shingles"]

        def block(n: str):
            return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

        def each(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        left = large.where(outside).withColumns({"i": block("n_i"), "side": F.lit(0)}).withColumn("j", each("n_j"))
        right = large.withColumns({"j": block("n_j"), "side": F.lit(1)}).withColumn("i", each("n_i"))
        both = left.select(*kept).unionByName(right.select(*kept))
        both = both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return both.mapInPandas(_blockwise(self.similarity), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, by_count: bool = True) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs`` (doc_id, text).

    Two texts are linked when their five-word shingles have a Jaccard similarity of at least
    ``similarity``, each shingle weighed by its count in the text (or all alike, see
    NearDuplicates). Classes are connected components, named by their least doc_id; kept marks
    the document of that id. Equal texts are always one class. A text of one to four words has
    one shingle, a text without words is linked to equal texts only, a null text to none.
    doc_id identifies a document: rows that share one share a class, whatever their texts. A
    row without id gets the class of its text, and is kept only where no row of the class has
    an id and its text is the least by digest (a null text without id is a class of its own).
    """
    found = NearDuplicates(docs, similarity, by_count).classes()
    nameless = F.col("digest").isNull() | F.col("digest").eqNullSafe(F.col("head"))
    kept = F.when(F.col("doc_id").isNull(), F.col("class_id").isNull() & nameless).otherwise(
        F.col("doc_id") == F.col("class_id")
    )
    return found.select("doc_id", "class_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, by_count: bool = True) -> DataFrame:
    """One row of each near-duplicate class, columns as in ``docs``.

    It is that of the class's least doc_id, or of the least text by digest where no row of the
    class has an id. Of rows that share a doc_id the least text stays. Null texts without id stay.
    """
    found = NearDuplicates(docs, similarity, by_count).classes()
    gone = written(
        found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("__gone")).distinct(),
        "dup-gone",
    )
    out = docs.join(sent_if_few(gone), F.col("doc_id") == F.col("__gone"), "left_anti")
    twice = found.where("doc_id = class_id").groupBy(F.col("doc_id").alias("__twice")).agg(F.count(F.lit(1)).alias("n"))
    twice = written(twice.where(F.col("n") > 1).select("__twice"), "dup-twice")
    if not twice.isEmpty():
        repeated = F.col("doc_id") == F.col("__twice")
        at = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
        once = out.join(twice, repeated, "left_semi").withColumn("__at", at).where("__at = 1").select(*docs.columns)
        out = out.join(twice, repeated, "left_anti").unionByName(once)
    if not found.where(F.col("doc_id").isNull() & F.col("digest").isNotNull()).isEmpty():
        heads = found.where(F.col("doc_id").isNull() & (F.col("digest") == F.col("head")))
        heads = heads.select(F.col("head").alias("__head")).distinct()
        lone = out.where(F.col("doc_id").isNull() & F.col("text").isNotNull())
        lone = lone.withColumn("__digest", text_digest()).join(heads, F.col("__digest") == F.col("__head"), "left_semi")
        lone = lone.dropDuplicates(["__digest"]).select(*docs.columns)
        out = out.where(F.col("doc_id").isNotNull() | F.col("text").isNull()).unionByName(lone)
    return out


def near_duplicate_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
#: All pairs that share a shingle, with their exact similarity by counts, and the components of the links.
NEAR_DUPLICATE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, k || '#' || row_number() OVER (PARTITION BY doc_id, k) AS k
  FROM (
    SELECT doc_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)
  )
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= {SIMILARITY} * (na.n + nb.n - c)
  UNION SELECT m, doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM d) WHERE m <> doc_id
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, root) AS (
  SELECT DISTINCT a, a FROM e
  UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root <= e.b
), c AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, coalesce(root, doc_id) AS class_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN c ON node = doc_id
"""
