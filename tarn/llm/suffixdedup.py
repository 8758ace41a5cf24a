"""Exact substring dedup by induced sorting of sampled suffixes over the whole corpus.

1. Sample: every LENGTH-byte window has one anchor, the leftmost least hash of its ANCHOR-byte
   substrings. Equal windows have their anchors at equal offsets, so anchors that occur once
   belong to no repeated window and go.
2. Sort: the suffixes of the other anchors are sorted by anchor and LENGTH bytes by Spark's
   spilling sort, whose disk-backed runs meet in priority queues; neighbours give
   common-prefix values.
3. Induce: the order of the suffixes k + 1 bytes left of the anchors follows from that k bytes
   left, by the preceding byte; the common prefix of neighbours is k plus the least value
   between them. A suffix of common prefix LENGTH or more starts a repeated window.

Only distinct contexts (the bytes around an anchor) are induced; their places wait in a table
that is joined back. An anchor of more than HOT_PLACES places isn't induced in one task: the
windows of its distinct contexts are counted by Spark.

Suffixes are compared by bytes; 64-bit hashes only bring them together. Whole texts are told
apart by 128 bits of SHA-256, contexts and the windows of hot anchors by 128-bit BLAKE2 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import BASE, BASE_INVERSE, U64, bounded_batches, byte_view, mix64, pieces, powers, written

LENGTH = 200
ANCHOR = 64
#: Anchor places in a window.
SPAN = LENGTH - ANCHOR + 1
CHUNK_BYTES = 3 << 19
#: Bits for places in a segment; longer texts are sampled in overlapping segments.
PLACE_BITS = 26
PLACE_MASK = (1 << PLACE_BITS) - 1
SEGMENT = 1 << 25
#: Suffixes that are induced together, unless one anchor has more distinct ones.
GROUP_ROWS = 20_000
#: Places from which an anchor is hot: its windows are compared one by one, over all tasks.
HOT_PLACES = 50_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, from block-wise running minima."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place in ``data``) of the anchors of all windows inside rows of at most SEGMENT bytes."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, U64), np.empty(0, np.int64)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, n), out=sums[1:])
    h = sums[ANCHOR:] - sums[: n - ANCHOR + 1]
    h *= powers(BASE_INVERSE, n)[: n - ANCHOR + 1]
    h = mix64(h)
    key = (h & U64(~PLACE_MASK & (1 << 64) - 1)) | np.arange(len(h), dtype=U64)
    least = sliding_least(key, SPAN)
    lengths = np.diff(offsets)
    inside = np.zeros(len(least), bool)
    edge = np.zeros(len(least) + 1, np.int64)
    long_ = lengths >= LENGTH
    np.add.at(edge, offsets[:-1][long_], 1)
    np.add.at(edge, offsets[1:][long_] - LENGTH + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    place = (least[inside] & U64(PLACE_MASK)).astype(np.int64)
    fresh = np.ones(len(place), bool)
    fresh[1:] = place[1:] != place[:-1]
    place = place[fresh]
    return h[place], place


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", CHUNK_BYTES):
        data, offsets = byte_view(piece.column("text"))
        ids = piece.column("tid")
        if len(data) <= SEGMENT:
            cuts = [(data, offsets, 0)]
        else:  # one long text
            step = SEGMENT - LENGTH
            cuts = [(data[a : a + SEGMENT], np.array([0, min(SEGMENT, len(data) - a)]), a) for a in range(0, len(data), step)]
        for part, bounds, shift in cuts:
            h, place = anchors(part, bounds)
            row = np.searchsorted(bounds, place, side="right") - 1
            # A text's places of one anchor make one row, so a periodic text isn't a hot anchor.
            by = np.lexsort((place, h, row))
            h, row, place = h[by], row[by], place[by]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            starts = np.flatnonzero(fresh)
            local = place - bounds[row] + shift
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[starts].view(np.int64)),
                    ids.take(pa.array(row[starts])),
                    pa.array(local[starts]),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)), pa.int32()), pa.array(local)),
                ],
                names=["anchor", "tid", "at", "places"],
            )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, text and first place: those whose anchor stands at two places or more.

    Copies of a row are one. A run of one anchor may go over many batches: only its first row is
    held back, until another comes.
    """
    held = last = None
    many = False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        t = batch.column(1)
        other = pc.not_equal(t.slice(1), t.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | other | (p[1:] != p[:-1])
        if last is not None:
            fresh[0] = (a[0], t[0].as_py(), p[0]) != last
        last = (a[-1], t[-1].as_py(), p[-1])
        rows = np.flatnonzero(fresh)
        if len(rows) == 0:
            continue
        a = a[rows]
        keep = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)[rows] > 1
        same = a[1:] == a[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None and a[0] == held[0]:
            keep |= a == held[0]
            if not many:
                yield held[1]
            many = True
        if held is None or a[-1] != held[0]:
            held = (a[-1], batch.slice(int(rows[-1]), 1))
            many = bool(keep[-1])
        if keep.any():
            yield batch.take(pa.array(rows[keep]))


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


CONTEXT_ROWS = "anchor long, cid binary, tid binary, right binary, left binary, places array<long>"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor, LENGTH bytes from it, and up to SPAN - 1 bytes before it, backwards, with their places in the text.

    cid is the digest of the context.
    """
    before = None
    for piece in pieces(batches, "text", CHUNK_BYTES):
        data, offsets = byte_view(piece.column("text"))
        raw = data.tobytes()
        found: dict[str, list] = {"anchor": [], "cid": [], "tid": [], "right": [], "left": [], "places": []}
        for i, (tid, sampled) in enumerate(zip(piece.column("tid").to_pylist(), piece.column("sampled"))):
            if tid == before:
                continue  # a copy: rows come sorted by text
            before = tid
            low, high = int(offsets[i]), int(offsets[i + 1])
            of: dict[tuple, list[int]] = {}
            for s in sampled.as_py():
                for place in s["places"]:
                    at = low + place
                    key = (s["anchor"], raw[at : min(high, at + LENGTH)], raw[max(low, at - SPAN + 1) : at][::-1])
                    of.setdefault(key, []).append(place)
            for (anchor, right, left), places in of.items():
                found["anchor"].append(anchor)
                found["cid"].append(_digest(bytes([len(right)]), right, left))
                found["tid"].append(tid)
                found["right"].append(right)
                found["left"].append(left)
                found["places"].append(sorted(set(places)))
        kinds = {"anchor": pa.int64(), "cid": pa.binary(), "tid": pa.binary(), "right": pa.binary(), "left": pa.binary()}
        kinds["places"] = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(found[k], v) for k, v in kinds.items()], names=list(kinds))


def _padded(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of a matrix (unused places 0) and their lengths."""
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    flat = np.frombuffer(b"".join(column), np.uint8)
    out = np.zeros((len(column), width), np.uint8)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def induce(group: np.ndarray, right: list[bytes], left: list[bytes], twice: np.ndarray) -> np.ndarray:
    """bool[n, SPAN]: whether the window that starts k bytes left of anchor i stands elsewhere too.

    Rows are distinct, sorted by group and right; ``twice`` marks those that occur again
    exactly, whose own windows therefore all repeat.
    """
    n = len(group)
    r, r_size = _padded(right, LENGTH)
    lf, l_size = _padded(left, SPAN - 1)
    repeated = np.zeros((n, SPAN), bool)
    if n == 0:
        return repeated
    ks = np.arange(SPAN)
    fits = (ks[None, :] <= l_size[:, None]) & (LENGTH - ks[None, :] <= r_size[:, None])
    repeated[twice] = fits[twice]
    # Common prefix of each row's suffix with the row before it (0 across anchors).
    common = np.zeros(n, np.int64)
    if n > 1:
        unequal = r[1:] != r[:-1]
        first = np.where(unequal.any(axis=1), unequal.argmax(axis=1), LENGTH)
        shortest = np.minimum(r_size[1:], r_size[:-1])
        common[1:] = np.where(group[1:] == group[:-1], np.minimum(first, shortest), 0)
    table = [common]
    while 2 ** len(table) <= n:
        half, step = table[-1], 2 ** (len(table) - 1)
        table.append(np.minimum(half[:-step], half[step:]))
    # Rows of a class agree in the k bytes before the anchor, and stand in order of their suffixes.
    order = np.arange(n)
    start = np.ones(n, bool)
    start[1:] = group[1:] != group[:-1]
    klass = np.cumsum(start) - 1
    for k in range(SPAN):
        if k:
            able = l_size[order] >= k
            order, klass = order[able], klass[able]
            key = klass * 256 + lf[order, k - 1]
            by = np.argsort(key, kind="stable")
            order, key = order[by], key[by]
            start = np.ones(len(order), bool)
            start[1:] = key[1:] != key[:-1]
            klass = np.cumsum(start) - 1
            alone = start & np.append(start[1:], True)
            if alone.any():
                order, klass = order[~alone], klass[~alone]
        if len(order) < 2:
            if len(order) == 0:
                break
            continue
        joined = np.flatnonzero(klass[1:] == klass[:-1])
        low, high = order[joined] + 1, order[joined + 1]  # least of common[low .. high]
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        least = np.empty(len(joined), np.int64)
        for depth in np.unique(level):
            here = level == depth
            least[here] = np.minimum(table[depth][low[here]], table[depth][high[here] - 2**depth + 1])
        long_ = joined[least + k >= LENGTH]
        repeated[order[long_], k] = True
        repeated[order[long_ + 1], k] = True
    return repeated


RUN_ROWS = "cid binary, first long, last long"


def _runs(cids: list[bytes], found: np.ndarray) -> pa.RecordBatch:
    """Runs of window starts, first and last relative to the anchor, from ``found`` (bool[n, SPAN], by bytes to the left)."""
    # From the leftmost: k falls as the start moves right.
    turned = found[:, ::-1].astype(np.int8)
    step = np.diff(np.pad(turned, ((0, 0), (1, 1))), axis=1)
    i, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return pa.RecordBatch.from_arrays(
        [pa.array([cids[row] for row in i], pa.binary()), pa.array(a - (SPAN - 1)), pa.array(b - 1 - (SPAN - 1))],
        names=["cid", "first", "last"],
    )


def _induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows from sorted contexts; whole anchors are induced together."""
    rows: list[list] = []  # distinct contexts: [anchor, cid, right, left, whether it has two places]
    last = None

    def solve(chunk: list[list]) -> pa.RecordBatch:
        group, cids, right, left, many = zip(*chunk)
        return _runs(cids, induce(np.array(group), right, left, np.array(many)))

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("anchor", "cid", "right", "left", "tid", "n")]
        for anchor, cid, right, left, tid, n in zip(*columns):
            if rows and rows[-1][1] == cid:
                # The same text may have come to two tasks; its places count once.
                rows[-1][4] |= tid != last
                last = tid
                continue
            if len(rows) >= GROUP_ROWS and rows[-1][0] != anchor:
                yield solve(rows)
                rows = []
            rows.append([anchor, cid, right, left, n > 1])
            last = tid
    if rows:
        yield solve(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each window of distinct contexts, by its k bytes left of the anchor."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out: dict[str, list] = {"window": [], "cid": [], "k": [], "many": []}
            for cid, right, left, many in zip(*(part.column(c).to_pylist() for c in ("cid", "right", "left", "many"))):
                text, middle = left[::-1] + right, len(left)
                ks = range(max(0, LENGTH - len(right)), min(SPAN - 1, middle) + 1)
                # k is in the digest: one window seen from two anchor places is no repeat.
                out["window"] += [_digest(bytes([k]), text[middle - k : middle - k + LENGTH]) for k in ks]
                out["cid"] += [cid] * len(ks)
                out["k"] += ks
                out["many"] += [many] * len(ks)
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ks = batch.column("ks")
        found = np.zeros((batch.num_rows, SPAN), bool)
        row = np.repeat(np.arange(batch.num_rows), ks.value_lengths().to_numpy(zero_copy_only=False))
        found[row, ks.flatten().to_numpy(zero_copy_only=False)] = True
        yield _runs(batch.column("cid").to_pylist(), found)


def _hot_runs(contexts: DataFrame) -> DataFrame:
    """The runs of ``_induced`` for anchors of any number of contexts: no task holds an anchor."""
    distinct = contexts.groupBy("cid").agg(
        F.first("right").alias("right"),
        F.first("left").alias("left"),
        ((F.min("tid") != F.max("tid")) | (F.max(F.size("places")) > 1)).alias("many"),
    )
    windows = written(distinct.mapInArrow(_windows, "window binary, cid binary, k int, many boolean"), "sub-windows")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"))
    again = again.where((F.col("n") > 1) | F.col("many")).select("window")
    found = windows.join(again, "window", "left_semi").groupBy("cid").agg(F.collect_list("k").alias("ks"))
    return found.mapInArrow(_joined_runs, RUN_ROWS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(tid, copies, spans) of texts with removable bytes; ``docs`` has tid and text.

    copies: the text stands more than once, so all of it (of LENGTH bytes or more) repeats.
    """
    anchor_rows = "anchor long, tid binary, at long, places array<long>"
    sampled = docs.mapInArrow(_sample, anchor_rows)
    sampled = sampled.repartition("anchor").sortWithinPartitions("anchor", "tid", "at")
    repeated = written(sampled.mapInArrow(_repeated, anchor_rows), "sub-places")
    by_text = repeated.groupBy("tid").agg(F.collect_list(F.struct("anchor", "places")).alias("sampled"))
    # Sorted by text, so that copies of one stand together.
    texts = docs.join(by_text, "tid").sortWithinPartitions("tid")
    contexts = written(texts.mapInArrow(_contexts, CONTEXT_ROWS), "sub-contexts")
    hot = repeated.groupBy("anchor").agg(F.sum(F.size("places")).alias("n")).where(F.col("n") > HOT_PLACES)
    hot = written(hot.select("anchor"), "sub-hot")
    some_hot = not hot.isEmpty()
    # Hot anchors are fewer than bytes of text over HOT_PLACES.
    cool = contexts.join(F.broadcast(hot), "anchor", "left_anti") if some_hot else contexts
    cool = cool.select("anchor", "cid", "right", "left", "tid", F.size("places").alias("n"))
    cool = cool.repartition("anchor").sortWithinPartitions("anchor", "right", "left", "tid")
    runs = cool.mapInArrow(_induced, RUN_ROWS)
    if some_hot:
        runs = runs.unionByName(_hot_runs(contexts.join(F.broadcast(hot), "anchor", "left_semi")))
    spans = contexts.select("cid", "tid", F.explode("places").alias("at")).join(runs, "cid")
    spans = spans.select("tid", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + LENGTH).alias("end"))
    spans = spans.groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "sub-spans")
    copies = docs.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("tid", F.lit(True).alias("copies"))
    return spans.join(copies, "tid", "full")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", CHUNK_BYTES):
        data, offsets = byte_view(piece.column("text"))
        raw = data.tobytes()
        copies = piece.column("copies").to_pylist()
        spans = piece.column("spans").to_pylist()
        removed, runs, hashes, kept = [], [], [], []
        for i in range(piece.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            merged: list[list[int]] = []
            if copies[i] and len(text) >= LENGTH:
                merged = [[0, len(text)]]
            else:
                for s in sorted((s["start"], s["end"]) for s in spans[i] or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
            parts, at = [], 0
            for s, e in merged:
                parts.append(text[at:s])
                at = e
            parts.append(text[at:])
            rest = b"".join(parts)
            removed.append(len(text) - len(rest))
            runs.append(len(merged))
            hashes.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array(hashes, pa.string()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    Every byte inside a LENGTH-byte string of its text that also starts elsewhere, in the same
    text or another, goes; kept has the other bytes. Null and empty texts and those below
    LENGTH bytes keep all. Repeated rows are copies: all their bytes go, as in any copies of
    LENGTH bytes or more. Adjacent and overlapping strings make one span.
    """
    keyed = bounded_batches(docs.select("doc_id", "text", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("tid")))
    found = repeated_spans(keyed.where(F.octet_length("text") >= LENGTH).select("tid", "text"))
    joined = keyed.join(found, "tid", "left").select("doc_id", "text", "copies", "spans")
    return joined.mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def suffix_dedup_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).drop("kept")


#: Every window of LENGTH bytes, as hexadecimal text, and the union of those that repeat.
SUFFIX_DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS k
  FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {LENGTH} + 1)) AS i FROM d WHERE length(h) >= {2 * LENGTH})
), again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM again)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM s),
m AS (
  SELECT r, min(i) AS a, max(i) + {LENGTH} AS b
  FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM g) GROUP BY r, run
), gaps AS (
  SELECT m.r, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY m.r ORDER BY a), 0) + 1,
    2 * (a - coalesce(lag(b) OVER (PARTITION BY m.r ORDER BY a), 0))) AS piece FROM m JOIN d ON d.r = m.r
), q AS (
  SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS kept FROM gaps GROUP BY r
)
SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN q USING (r)
"""
