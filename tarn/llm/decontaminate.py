"""Benchmark decontamination by suffix arrays over the training shards.

Each task cuts its documents into shards of some megabytes, builds a suffix array over the
shard's words, and binary-searches every suffix of the benchmark in it. Interval bounds give
all verbatim occurrences; occurrences of successive windows chain into the longest matches and
their places. Documents never shuffle. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import BASE, U64, bounded_batches, byte_view, mix64, pieces, with_columns, words

WINDOW = 10
#: Text bytes of a suffix-array shard.
SHARD_BYTES = 1 << 20
#: A block of the benchmark that is sent to all tasks holds at most so many text bytes,
#: or one item. Larger benchmarks are searched block by block.
BLOCK_BYTES = 32 << 20


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions in order of their first ``depth`` (or more) symbols.

    Doubling over ties only: a suffix whose rank is already its own is never sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    if n == 0:
        return order
    ranked = symbols[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = first
    reach = 1
    while reach < depth:
        lone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~lone)
        if len(slots) == 0:
            break
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + reach, n)] + 1
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        fresh[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        reach *= 2
    return order


class Tests:
    """The distinct word windows of a block of benchmark items, ready to be searched.

    Items of equal words are one text with several ids. ``start`` and ``length`` are those of
    each distinct window, ``first[w]`` to ``first[w + 1]`` its places: ``text`` and ``place``.
    """

    def __init__(self, ids: list, texts: list, width: int = WINDOW):
        data, offsets = byte_view(pa.array(texts, pa.string()))
        hashes, _, _, bounds = words(data, offsets)
        by_words: dict[bytes, list[int]] = {}
        for i in range(len(ids)):
            if bounds[i] < bounds[i + 1]:
                by_words.setdefault(hashes[bounds[i] : bounds[i + 1]].tobytes(), []).append(i)
        self.hashes = np.frombuffer(b"".join(by_words), U64) if by_words else np.empty(0, U64)
        counts = np.array([len(k) // 8 for k in by_words], np.int64)
        self.ids = [sorted({str(ids[i]) for i in group}) for group in by_words.values()]
        n = np.maximum(1, counts - width + 1)
        text = np.repeat(np.arange(len(counts)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(counts) - counts)[text] + place
        length = np.minimum(width, counts)[text]
        key = mix64(length.astype(U64))
        for k in range(width):
            inside = k < length
            key[inside] = mix64(key[inside] * U64(BASE) + self.hashes[start[inside] + k] + U64(k + 1))
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(order)]
        self.first = np.append(np.flatnonzero(fresh), len(order))
        self.text, self.place = text[order], place[order]
        self.start, self.length = start[order][fresh], length[order][fresh]
        self.width = width

    def occurrences(self, symbols: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every place in ``symbols`` where a window's words stand.

        ``symbols`` are even ranks of ``known`` (sorted hashes), -2 between documents.
        """
        if len(self.start) == 0 or len(symbols) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.searchsorted(known, self.hashes)
        there = known[np.minimum(at, len(known) - 1)] == self.hashes if len(known) else np.zeros(len(at), bool)
        mine = np.where(there, 2 * at, 2 * at - 1)
        missing = np.concatenate(([0], np.cumsum(~there)))
        possible = np.flatnonzero(missing[self.start + self.length] == missing[self.start])
        if len(possible) == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = suffix_array(symbols, self.width)
        start, length = self.start[possible], self.length[possible]
        padded = np.append(symbols, np.full(self.width, -3, symbols.dtype))

        def bound(upper: bool) -> np.ndarray:
            low = np.zeros(len(start), np.int64)
            high = np.full(len(start), len(order), np.int64)
            while True:
                open_ = np.flatnonzero(low < high)
                if len(open_) == 0:
                    return low
                mid = (low[open_] + high[open_]) // 2
                suffix = order[mid]
                sign = np.zeros(len(open_), np.int8)
                for k in range(self.width):
                    live = np.flatnonzero((sign == 0) & (k < length[open_]))
                    if len(live) == 0:
                        break
                    a, b = padded[suffix[live] + k], mine[start[open_[live]] + k]
                    sign[live] = np.sign(a - b)
                right = sign <= 0 if upper else sign < 0
                low[open_[right]] = mid[right] + 1
                high[open_[~right]] = mid[~right]

        low, high = bound(False), bound(True)
        n = high - low
        window = np.repeat(possible, n)
        slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return window, order[slot]


def search(batch: pa.RecordBatch, column: str, tests: Tests):
    """Per row: word count, and (window, place, row) of every occurrence."""
    data, offsets = byte_view(batch.column(column))
    hashes, _, _, bounds = words(data, offsets)
    rows = batch.num_rows
    counts = np.diff(bounds)
    known = np.unique(hashes)
    symbols = np.full(len(hashes) + rows, -2, np.int64)
    owner = np.repeat(np.arange(rows), counts)
    at = np.arange(len(hashes)) + owner
    symbols[at] = 2 * np.searchsorted(known, hashes)
    window, position = tests.occurrences(symbols, known)
    row = np.searchsorted(bounds[1:] + np.arange(1, rows + 1), position, side="right")
    return counts, window, position, row, len(symbols), at, owner


def report(batch: pa.RecordBatch, column: str, tests: Tests, before: dict | None = None) -> dict:
    """Per row: words, hit words, items and matches, added to those of the blocks ``before``.

    A match is (start, words, item, item_start), in words: a run that can't be longer.
    """
    counts, window, position, row, n, at, owner = search(batch, column, tests)
    rows = batch.num_rows
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, position, 1)
    np.add.at(edge, position + tests.length[window], -1)
    hit = np.cumsum(edge)[:n] > 0
    items: list[list] = [[] for _ in range(rows)]
    matches: list[list] = [[] for _ in range(rows)]
    if before is not None:
        hit |= before["hit"]
        items, matches = before["items"], before["matches"]
    n_hit = np.bincount(owner, weights=hit[at], minlength=rows).astype(np.int64)
    if len(window):
        places = tests.first[window + 1] - tests.first[window]
        which = np.repeat(np.arange(len(window)), places)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)
        entry = tests.first[window[which]] + nth
        text, place, p, r = tests.text[entry], tests.place[entry], position[which], row[which]
        for one, i in np.unique(np.stack([r, text]), axis=1).T:
            items[one] += tests.ids[i]
        # Occurrences of successive windows at successive places are one longer match.
        by = np.lexsort((p, p - place, text))
        text, place, p, r, size = text[by], place[by], p[by], r[by], tests.length[window[which]][by]
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (p[1:] != p[:-1] + 1) | (place[1:] != place[:-1] + 1)))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(new)) - 1
        begin = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]  # a row's words, and the mark after them
        for one, start, length, i, from_ in zip(
            r[a].tolist(), (p[a] - begin[r[a]]).tolist(), (p[b] - p[a] + size[b]).tolist(), text[a].tolist(), place[a].tolist()
        ):
            matches[one].append({"start": start, "words": length, "item_id": tests.ids[i][0], "item_start": from_})
    return {"n_words": counts, "n_hit": n_hit, "items": items, "matches": matches, "hit": hit}


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded size; its size is checked before anything is fetched.

    Beyond one block the items are dealt to blocks by a hash, each fetched alone.
    """
    sized = benchmark.select("item_id", "text").dropDuplicates()
    total = sized.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    for k in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        rows = sorted(part.collect(), key=lambda r: (str(r[0]), r[1] or ""))
        yield [r[0] for r in rows], [r[1] for r in rows]


MATCH = "struct<start:long, words:long, item_id:string, item_start:long>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, prefix: str = ""
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids, longest_match and matches added, each name after ``prefix``.

    A document word inside any occurrence of ``width`` consecutive item words is hit; an item
    of fewer words, but not none, is one window. matches are the maximal verbatim runs, of a
    window at least: start and words in the document, item_id (the least of items of equal
    words) and item_start in the item, counted in words from 0; longest_match is the most words
    of one. A null or empty text has no words and no hits; null items have no windows. item_ids
    are distinct, sorted as strings. Repeated documents are judged one by one, repeated items
    count once. An empty benchmark hits nothing. Added columns replace input columns of the
    same names.
    """
    spark = docs.sparkSession
    added = T.StructType.fromDDL(f"n_words long, n_hit long, item_ids array<string>, longest_match long, matches array<{MATCH}>")
    names = [prefix + f.name for f in added]
    docs = bounded_batches(docs.drop(*names))
    blocks = [spark.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark)]
    schema = T.StructType(docs.schema.fields + [T.StructField(n, f.dataType) for n, f in zip(names, added)])
    match = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = Tests(*blocks[0].value, width) if len(blocks) == 1 else None
        for piece in pieces(batches, text, SHARD_BYTES):
            hits = None
            for block in blocks:
                hits = report(piece, text, alone or Tests(*block.value, width), hits)
                if alone is None:
                    vars(block).pop("_value", None)  # else the worker would keep every block
            found = hits["matches"]
            columns = (
                pa.array(hits["n_words"], pa.int64()),
                pa.array(hits["n_hit"], pa.int64()),
                pa.array([sorted(set(x)) for x in hits["items"]], pa.list_(pa.string())),
                pa.array([max((m["words"] for m in x), default=0) for x in found], pa.int64()),
                pa.array([sorted(x, key=lambda m: (m["start"], -m["words"], m["item_id"], m["item_start"])) for x in found], pa.list_(match)),
            )
            extra = dict(zip(names, columns))
            fields = [piece.schema.field(i) for i in range(piece.num_columns)]
            fields += [pa.field(k, v.type) for k, v in extra.items()]
            yield with_columns(pa.schema(fields), piece, extra)

    return docs.mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit word, columns as in ``docs``."""
    return contamination(docs, benchmark, prefix="__").where(F.col("__n_hit") == 0).select(*docs.columns)


def items_digest(ids: str = "item_ids"):
    return F.sha2(F.array_join(F.col(ids), ","), 256)


def decontaminate_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (SELECT r, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
bp AS (
  SELECT DISTINCT item_id, i AS p, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT r, item_id, i - p AS d, bp.n AS n, i - row_number() OVER (PARTITION BY r, item_id, i - p ORDER BY i) AS g
  FROM dw JOIN bp ON dw.n = bp.n AND dw.k = bp.k
), longest AS (SELECT r, max(m) AS m FROM (SELECT r, count(*) - 1 + max(n) AS m FROM runs GROUP BY r, item_id, d, g) GROUP BY r),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(m, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN longest USING (r)
"""
