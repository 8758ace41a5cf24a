"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One replaced letter moves a word's letter counts by one up and one down, one inserted letter by one
up: whatever is near in spelling is near in counts. The words of each length are cut into cells by
a k-d tree fitted on a sample; a word goes to its own cell and to the cells whose boxes its
searches reach, for its own length and the next. Each cell has k-d trees of its words and of its
visitors; pairs of nodes are dropped by their boxes, pairs of words by their counts, and what is
left is compared letter by letter. Of pairs only each word's number and best near word move on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import give_back, written

#: Words of so many code points, met so often, take part; a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One of so many runs of a document loses a letter.
DROPS = 31
LETTERS = 26 + 64
#: Words in a cell, by estimate; a cell that no count can cut any more is cut into parts of it.
CELL = 16_384
#: Sampled words for each cell's worth of words, and in all: they place the cuts, never the results.
SAMPLES_A_CELL, MOST_SAMPLES = 64, 1_000_000
#: Words in a leaf, and pairs of leaves (or words) compared at once.
LEAF, AT_ONCE = 32, 1_024

_PLACE = np.full(256, LETTERS - 1, np.int64)
_PLACE[ord("a") : ord("z") + 1] = np.arange(26)
_PLACE[0xC0:] = 26 + np.arange(64)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, drops: int = DROPS, least: int = LEAST_LENGTH, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters of all whole texts, with the letters that the rule deletes.

    Null texts have none; in rows without doc_id, whose rule isn't defined, no letter is deleted.
    """
    runs = F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    rows = rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    rows = rows.select("run", h.alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    words = rows.select(F.when(F.col("h") % drops == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= often)


def letters(words: list[str]) -> np.ndarray:
    """uint8[n, length]: the code points of words of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(codes: np.ndarray) -> np.ndarray:
    """int8[n, LETTERS]: how often each letter stands in each word, 100 at most."""
    n = len(codes)
    flat = _PLACE[codes] + np.arange(n)[:, None] * LETTERS
    found = np.bincount(flat.ravel(), minlength=n * LETTERS).reshape(n, LETTERS)
    return np.minimum(found, 100).astype(np.int8)


def bits(vectors: np.ndarray) -> np.ndarray:
    """uint64[n, 2]: four levels of each plain letter, and folded ones of the others.

    A letter more or less changes one bit at most, so words differ in no more bits than in letters.
    """
    plain = (vectors[:, :26, None] > np.arange(4)).reshape(len(vectors), 104)
    rest = np.zeros((len(vectors), 24), bool)
    for k in range(26, LETTERS):
        rest[:, k % 24] |= vectors[:, k] > 0
    return np.packbits(np.concatenate([plain, rest], axis=1), axis=1).view(np.uint64)


@dataclass
class Cuts:
    """A k-d tree over the counts of one length: nodes with a cut or, if ``letter`` is -1, a cell."""

    letter: list[int] = field(default_factory=list)
    most: list[int] = field(default_factory=list)
    child: list[tuple[int, int]] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    parts: list[int] = field(default_factory=list)

    @staticmethod
    def of(sample: np.ndarray, words: float, cell: float) -> Cuts:
        """Cut until a cell has ``cell`` of ``words`` words, by their share of the sample."""
        tree = Cuts()

        def add(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
            node = len(tree.letter)
            size = words * len(rows) / len(sample)
            for values, x in ((tree.letter, -1), (tree.most, 0), (tree.child, (0, 0)), (tree.low, low), (tree.high, high)):
                values.append(x)
            tree.parts.append(max(1, math.ceil(size / (2 * cell))))
            spread = rows.std(axis=0) if len(rows) else np.zeros(LETTERS)
            k = int(spread.argmax())
            if size <= cell or len(rows) < 2 or spread[k] == 0:
                return node
            values = np.unique(rows[:, k])
            shares = np.array([(rows[:, k] <= v).mean() for v in values[:-1]])
            v = int(values[np.abs(shares - 0.5).argmin()])
            inside = rows[:, k] <= v
            left_high, right_low = high.copy(), low.copy()
            left_high[k], right_low[k] = v, v + 1
            tree.letter[node], tree.most[node], tree.parts[node] = k, v, 1
            tree.child[node] = (add(rows[inside], low, left_high), add(rows[~inside], right_low, high))
            return node

        add(sample, np.zeros(LETTERS, np.int8), np.full(LETTERS, 100, np.int8))
        return tree

    def reach(self, vectors: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that hold what has ``more`` letters more and ``less`` less at most."""
        letter, child = np.array(self.letter), np.array(self.child)
        used = np.unique(letter[letter >= 0])
        low, high, vectors = np.stack(self.low)[:, used], np.stack(self.high)[:, used], vectors[:, used]
        row, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        rows, cells = [], []
        while len(row):
            done = letter[node] < 0
            rows.append(row[done])
            cells.append(node[done])
            row, node = np.repeat(row[~done], 2), child[node[~done]].ravel()
            keep = np.ones(len(row), bool)
            for a in range(0, len(row), 1 << 16):
                v, x = vectors[row[a : a + (1 << 16)]], node[a : a + (1 << 16)]
                up = np.maximum(low[x] - v, 0).sum(axis=1, dtype=np.int32)
                down = np.maximum(v - high[x], 0).sum(axis=1, dtype=np.int32)
                keep[a : a + (1 << 16)] = (up <= more) & (down <= less)
            row, node = row[keep], node[keep]
        return np.concatenate(rows), np.concatenate(cells)


class Tree:
    """A k-d tree over the counts of a cell's words: halves by the letter that varies most, tight boxes."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.codes = letters(words)
        vectors = counts(self.codes)
        size = len(words)
        self.depth = max(0, math.ceil(math.log2(size / LEAF))) if size > LEAF else 0
        order = np.arange(size)
        for level in range(self.depth):
            edges = self._edges(level)
            segment = np.repeat(np.arange(1 << level), np.diff(edges))
            v = vectors[order].astype(np.float32)
            width = np.diff(edges)[:, None]
            mean = np.add.reduceat(v, edges[:-1]) / width
            vary = np.add.reduceat(v * v, edges[:-1]) / width - mean * mean
            key = v[np.arange(size), vary.argmax(axis=1)[segment]]
            order = order[np.lexsort((key, segment))]
        edges = self._edges(self.depth)
        v = vectors[order]
        self.low, self.high = [np.minimum.reduceat(v, edges[:-1])], [np.maximum.reduceat(v, edges[:-1])]
        for _ in range(self.depth):
            self.low.insert(0, np.minimum(self.low[0][::2], self.low[0][1::2]))
            self.high.insert(0, np.maximum(self.high[0][::2], self.high[0][1::2]))
        wide = int(np.diff(edges).max())
        place = edges[:-1, None] + np.arange(wide)
        self.leaf = np.where(place < edges[1:, None], np.append(order, -1)[np.minimum(place, size)], -1)
        self.bits = bits(vectors)

    def _edges(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * len(self.words)) >> level

    def leaf_pairs(self, other: Tree, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves whose boxes allow ``other``'s words ``more`` letters more and ``less`` less."""
        a = b = np.zeros(1, np.int64)
        for level in range(max(self.depth, other.depth) + 1):
            if level:
                if level <= self.depth:
                    a, b = np.repeat(a * 2, 2) + np.tile([0, 1], len(a)), np.repeat(b, 2)
                if level <= other.depth:
                    a, b = np.repeat(a, 2), np.repeat(b * 2, 2) + np.tile([0, 1], len(b))
                if self is other:
                    a, b = a[a <= b], b[a <= b]
            i, j = min(level, self.depth), min(level, other.depth)
            keep = np.ones(len(a), bool)
            for s in range(0, len(a), 1 << 15):
                x, y = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
                up = np.maximum(other.low[j][y] - self.high[i][x], 0).sum(axis=1, dtype=np.int32)
                down = np.maximum(self.low[i][x] - other.high[j][y], 0).sum(axis=1, dtype=np.int32)
                keep[s : s + (1 << 15)] = (up <= more) & (down <= less)
            a, b = a[keep], b[keep]
        return a, b

    def near(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of this tree and of ``other``, of the same length or one more, that are one edit apart.

        Blocks of pairs; of a tree and itself each pair comes once.
        """
        same = self.codes.shape[1] == other.codes.shape[1]
        one, two = self.leaf_pairs(other, 1, int(same))
        mine, theirs = np.append(self.bits, np.zeros((1, 2), np.uint64), axis=0), np.append(other.bits, ~np.zeros((1, 2), np.uint64), axis=0)
        for s in range(0, len(one), AT_ONCE):
            left, right = self.leaf[one[s : s + AT_ONCE]], other.leaf[two[s : s + AT_ONCE]]
            apart = np.zeros((len(left), left.shape[1], right.shape[1]), np.uint8)
            for k in range(2):
                apart += np.bitwise_count(mine[left, k][:, :, None] ^ theirs[right, k][:, None, :])
            pair, x, y = np.nonzero(apart <= 1 + same)
            x, y = left[pair, x], right[pair, y]
            if self is other:  # a leaf with itself
                twice = (one[s : s + AT_ONCE] == two[s : s + AT_ONCE])[pair] & (x >= y)
                x, y = x[~twice], y[~twice]
            real = (x >= 0) & (y >= 0)
            yield from self._confirmed(other, x[real], y[real])

    def _confirmed(self, other: Tree, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the pairs, those whose letters, in order, differ by one edit."""
        length = self.codes.shape[1]
        step = max(1, (4 << 20) // max(1, length))
        for s in range(0, len(x), step):
            i, j = x[s : s + step], y[s : s + step]
            a, b = self.codes[i], other.codes[j]
            if b.shape[1] == length:
                keep = (a != b).sum(axis=1) == 1
            else:
                ahead, behind = a == b[:, :-1], a == b[:, 1:]
                first = np.where(ahead.all(axis=1), length, ahead.argmin(axis=1))
                last = np.where(behind.all(axis=1), 0, length - behind[:, ::-1].argmin(axis=1))
                keep = last <= first
            yield i[keep], j[keep]


def _summed(tree: Tree, other: Tree) -> Iterator[pa.RecordBatch]:
    """For each word of either tree with near words in the other: their number and the best of them."""
    size, wide = len(tree.words), len(other.words)
    rank = [np.empty(len(t.words), np.int64) for t in (tree, other)]
    ranked = [np.lexsort((_alphabetic(t), -t.n)) for t in (tree, other)]
    for r, order in zip(rank, ranked):
        r[order] = np.arange(len(order))
    found = [np.zeros(size, np.int64), np.zeros(wide, np.int64)]
    best = [np.full(size, wide), np.full(wide, size)]
    if tree is other:
        found[1], best[1] = found[0], best[0]
    for i, j in tree.near(other):
        for k, (mine, its) in enumerate(((i, j), (j, i))):
            np.add.at(found[k], mine, 1)
            np.minimum.at(best[k], mine, rank[1 - k][its])
    for k, (t, o) in enumerate(((tree, other), (other, tree))[: 1 if tree is other else 2]):
        hit = np.flatnonzero(found[k])
        if len(hit):
            to = ranked[1 - k][best[k][hit]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t.words[x] for x in hit], pa.string()),
                    pa.array(t.n[hit]),
                    pa.array(found[k][hit]),
                    pa.array(o.n[to]),
                    pa.array([o.words[x] for x in to], pa.string()),
                ],
                names=["word", "n", "n_near", "best_n", "best"],
            )


def _alphabetic(tree: Tree) -> np.ndarray:
    """Each word's place in code-point order; Latin-1 bytes are in that order."""
    order = sorted(range(len(tree.words)), key=tree.words.__getitem__)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _key(length: int, cell: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (np.int64(length) << 40) | (cell.astype(np.int64) << 20) | part.astype(np.int64)


def _spread(cuts: Cuts | None, cells: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, part) of all parts of the cells."""
    n = np.array(cuts.parts)[cells] if cuts else np.ones(len(cells), np.int64)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(rows, n), np.repeat(cells, n), part


def routed(words: DataFrame, cuts: dict[int, Cuts]) -> DataFrame:
    """(cell, visits, word, n): each word in its cell, and as a visitor where its searches lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("word").to_pylist()
            sizes = np.array(list(map(len, names)))
            for length in map(int, np.unique(sizes)):
                rows = np.flatnonzero(sizes == length)
                own, above = cuts.get(length), cuts.get(length + 1)
                home, part = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                vectors = counts(letters([names[r] for r in rows])) if own or above else None
                trips = []
                if own:
                    at, cell = own.reach(vectors, 0, 0)
                    home[at] = cell
                    part = np.array([zlib.crc32(names[r].encode("latin-1")) for r in rows]) % np.array(own.parts)[home]
                    at, cell, to = _spread(own, *own.reach(vectors, 1, 1)[::-1])
                    # Of two cells, and of two parts of one, the lesser's words visit the other.
                    on = (cell > home[at]) | (cell == home[at]) & (to > part[at])
                    trips.append((at[on], _key(length, cell[on], to[on])))
                at, cell = above.reach(vectors, 1, 0) if above else (np.arange(len(rows)), np.zeros(len(rows), np.int64))
                at, cell, to = _spread(above, cell, at)
                trips.append((at, _key(length + 1, cell, to)))
                for at, key, visits in [(np.arange(len(rows)), _key(length, home, part), 0), *((*t, 1) for t in trips)]:
                    for s in range(0, len(at), 1 << 16):
                        end = min(s + (1 << 16), len(at))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key[s:end]),
                                pa.array(np.full(end - s, visits, np.int32)),
                                *(batch.column(c).take(pa.array(rows[at[s:end]])) for c in ("word", "n")),
                            ],
                            names=["cell", "visits", "word", "n"],
                        )

    return words.select("word", "n").mapInArrow(run, "cell long, visits int, word string, n long")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words in rows that come by cell, its own words before its visitors."""
    here, own, tree = None, [], None

    def built() -> Iterator[pa.RecordBatch]:
        nonlocal tree, own
        if own:
            tree = Tree([w for words, _ in own for w in words], np.concatenate([n for _, n in own]))
            own = []
            yield from _summed(tree, tree)

    for batch in batches:
        cell, visits = batch.column("cell").to_numpy(), batch.column("visits").to_numpy()
        edges = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (visits[1:] != visits[:-1])))
        for a, b in zip(edges, np.append(edges[1:], len(cell))):
            rows = batch.slice(a, b - a)
            words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
            if cell[a] != here:
                yield from built()
                here, tree = cell[a], None
            if not visits[a]:
                own.append((words, n))
                continue
            yield from built()
            if tree:
                by_length: dict[int, list[int]] = {}
                for k, w in enumerate(words):
                    by_length.setdefault(len(w), []).append(k)
                for some in by_length.values():
                    yield from _summed(Tree([words[k] for k in some], n[some]), tree)
    yield from built()
    give_back()


def fitted_cuts(words: DataFrame, cell: int = CELL, samples: int = SAMPLES_A_CELL, most: int = MOST_SAMPLES) -> dict[int, Cuts]:
    """The cells of every length of more than ``cell`` words (or their letters), placed by a bounded sample.

    The sample is that of least hashes: ``samples`` for each cell's worth of words, about ``most`` in
    all. It only decides how evenly words are dealt; every word is searched whatever the cuts.
    """
    # A long word weighs as much as its letters; as many rows as there are such lengths at most.
    weigh = F.col("n") * F.greatest(F.col("length"), F.lit(64)) / 64
    sizes = words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    large = {r["length"]: (r["n"], r["w"]) for r in sizes.select("length", "n", weigh.alias("w")).where(F.col("w") > cell).collect()}
    if not large:
        return {}
    share = min(1.0, most / (samples * sum(w / cell for _, w in large.values())))
    rates = [(length, min(1.0, share * samples * w / cell / n)) for length, (n, w) in large.items()]
    rates = words.sparkSession.createDataFrame(rates, "length int, rate double")
    chosen = words.select("word", F.length("word").alias("length")).join(F.broadcast(rates), "length")
    chosen = chosen.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    found: dict[int, list[str]] = {}
    for row in chosen.select("word").collect():
        found.setdefault(len(row[0]), []).append(row[0])
    return {length: Cuts.of(counts(letters(sorted(some))), large[length][1], cell) for length, some in found.items()}


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, best, best_n) of all words (word, n): near words, and the most frequent of them.

    Near words differ by exactly one inserted, deleted or replaced code point. Ties of the best go
    to the word least in code-point order. Words hold only the letters of ``word_counts``.
    """
    cuts = fitted_cuts(words, cell)
    # A cell is much work for its bytes, so partitions go by cells; small lengths share those that the session asks for.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")) + sum(sum(c.parts) for c in cuts.values())
    found = routed(words, cuts).repartition(tasks, "cell").sortWithinPartitions("cell", "visits").mapInArrow(
        _searched, "word string, n long, n_near long, best_n long, best string"
    )
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    rows = none.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return rows.select("word", "n", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def grouped(words: DataFrame, ratio: int = RATIO, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words (word, n).

    ``form`` is a word's best near word if that is ``ratio`` times as frequent at least, else null;
    ``root`` is where the forms lead, the word itself if nowhere. Frequencies grow by ``ratio`` on
    the way, so chains end, and rounds of doubling are few.
    """
    words = written(words.select("word", "n"), "spelling-words")
    usual = F.col("best_n") >= ratio * F.col("n")
    found = near_words(words, cell).select(
        "word",
        F.when(usual, F.col("best")).alias("form"),
        F.coalesce(F.when(usual, F.col("best")), F.col("word")).alias("root"),
        "n",
        "n_near",
        F.when(usual, F.col("best_n")).alias("form_n"),
    )
    found = written(found, "spelling-forms")
    ends = found.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    longest = int(math.log(ends["most"] / ends["least"], ratio) + 1e-9) if ends["most"] else 0
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        on = found.where(F.col("form").isNotNull()).select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = found.join(on, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next")
        found = written(found, "spelling-roots")
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grouped(word_counts(docs))


#: The same by masked and shortened words; CRC-32 by its table, which is made bit by bit.
SPELLING_SQL = r"""
WITH RECURSIVE table_bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(range(1, strlen(doc_id || ':' || run) + 1),
          lambda i: CAST('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i - 1, 2) AS BIGINT))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM low, crc_table),
cut AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                 ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS m FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS m FROM places),
one_less AS (SELECT s.word AS long, s.n AS long_n, w.word AS short, w.n AS short_n FROM shorter s JOIN words w ON s.m = w.word),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word
  UNION ALL SELECT long, long_n, short, short_n FROM one_less
  UNION ALL SELECT short, short_n, long, long_n FROM one_less),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r,
         count(*) OVER (PARTITION BY word) AS n_near
  FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chains AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""
