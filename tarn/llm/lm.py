"""Language-model scores: a causal self-attention model over subword ids, beside unigram counts of words.

Counts of words and of subwords are sums over all training texts. The attention model is trained
in numpy by the tasks: each round they start from the same weights, go over their windows of the
training texts, and Spark averages what they have learned. The rounds share out all windows, so each
id of a training text is learned from once. Texts are scored as a stream of blocks: a block's queries
look back over the block before and their own, masked to what is earlier and of the same text, so each
token is scored once with 16 to 31 tokens of context.

The next id is predicted in two steps. Ids are ranked by their counts; the first step chooses one
of 31 classes of 32 ids each or the tail, the second the id, in the tail by its count. So the
probabilities of all ids sum to one, and those of a text are of its lower-cased words and its end.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import BATCH_BYTES, bounded_batches, give_back, keep_freed, pieces, written

#: A public tokenizer's merges with their ranks; only the driver reads the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer words are encoded in pieces of so many characters.
LONG_WORD = 1_000
#: Most frequent words that every task holds; the others' counts come by a join.
SENT_WORDS = 200_000
ROUNDS, TRAINER_TOKENS, BATCH_TOKENS = 4, 1_000_000, 8_192
#: Tasks send their weights to be averaged in parts of so many.
PART = 1_024
BLOCK = 16
#: Training windows hold so many ids of a text after so many of context, as many as scoring ever looks back over.
WINDOW, LEAD = 512, 2 * BLOCK
CLASSES = MEMBERS = 32
TOP = (CLASSES - 1) * MEMBERS
#: Rows of embeddings: the ranks below TOP and so many that the others share.
ROWS = TOP + 32
WIDTH, HIDDEN = 16, 32
#: Bytes of text whose ids and positions a worker holds while it scores them.
SCORED_BYTES = BATCH_BYTES // 2
#: Tokens whose attention, and whose classes, are computed at once; a power of two of blocks.
AT_ONCE, CLASSED_AT_ONCE = 8_192, 65_536
#: Keeps exponentials finite in 32 bits.
MOST_LOGIT = np.float32(80)
_ONES = np.ones(CLASSES, np.float32)
END = ""


def held_out(key: str = "doc_id"):
    """Rows that nothing is learned from; those without a key aren't among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(7)) == 2, F.lit(False))


def lower_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice of texts, A-Z lower-cased, and how many each row has (null: none)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(column)), parts.value_lengths().to_numpy())
    return flat.filter(real), np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(column))


class Subwords:
    """Byte-pair encoding of words; the id after the last is the end of a text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.bytes = np.zeros(self.end, np.int64)
        for token, rank in ranks.items():
            self.bytes[rank] = len(token)

    @staticmethod
    def read(path: str = VOCABULARY) -> dict[bytes, int]:
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with a blank before it, and n + 1 offsets; END has the id of the end."""
        spans = pc.binary_length(words).to_numpy() + 1
        if len(spans) and 1 < spans.min() and spans.max() <= LONG_WORD:
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
            ids = np.array(self.encoding.encode_ordinary(f" {joined}"), np.int64)
            places = np.cumsum(self.bytes[ids]) - self.bytes[ids]
            starts = np.cumsum(spans, dtype=np.int64) - spans
            at = np.searchsorted(places, starts)
            if (at < len(places)).all() and (places[at] == starts).all():  # no id holds parts of two words
                return ids, np.append(at, len(ids))
        found = []
        for w in words.to_pylist():
            cut = [f" {w[:LONG_WORD]}", *(w[k : k + LONG_WORD] for k in range(LONG_WORD, len(w), LONG_WORD))]
            found.append([self.end] if w == END else [i for part in cut for i in self.encoding.encode_ordinary(part)])
        return np.array([i for ids in found for i in ids], np.int64), np.cumsum([0, *map(len, found)])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; the ends of texts are counted as the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", BATCH_BYTES):
            found = lower_words(piece.column("text"))[0].value_counts()
            words = pa.concat_arrays([found.field("values"), pa.array([END], pa.string())])
            yield pa.RecordBatch.from_arrays(
                [words, pa.concat_arrays([found.field("counts"), pa.array([piece.num_rows], pa.int64())])], names=["word", "n"]
            )

    rows = bounded_batches(texts.select("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(words: DataFrame, ranks) -> np.ndarray:
    """How often each id stands in texts of the given word counts; the last is the end. ``ranks``: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(ranks.value)
        total = np.zeros(subwords.end + 1, np.int64)
        for batch in batches:
            words, n = batch.column("word"), batch.column("n").to_numpy()
            real = pc.not_equal(words, END)
            keep = real.to_numpy(zero_copy_only=False)
            total[subwords.end] += n[~keep].sum()
            ids, offsets = subwords.encode(words.filter(real))
            np.add.at(total, ids, np.repeat(n[keep], np.diff(offsets)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    out = np.zeros(max(ranks.value.values()) + 2, np.int64)
    # As many rows as the vocabulary has ids at most.
    for row in words.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def _stream(column: pa.Array, subwords: Subwords):
    """The words of a slice of texts, an end after each text, and their subword ids as one stream.

    Returns the distinct words (the last is END), the index of each word among them and the words of
    each row, then the ids, how many each word has, and where each row's ids begin.
    """
    words, sizes = lower_words(column)
    coded = words.dictionary_encode()
    kinds = pa.concat_arrays([coded.dictionary, pa.array([END], pa.string())])
    ids, offsets = subwords.encode(coded.dictionary)
    index = np.insert(coded.indices.to_numpy(), np.cumsum(sizes), len(kinds) - 1)
    sizes = sizes + 1
    ids, offsets = np.append(ids, subwords.end), np.append(offsets, len(ids) + 1)
    length = np.diff(offsets)[index]
    begin = np.cumsum(length) - length
    at = np.repeat(offsets[index] - begin, length) + np.arange(length.sum())
    return kinds, index, sizes, ids[at], begin[np.cumsum(sizes) - sizes]


def training_windows(texts: DataFrame, ranks, rank: np.ndarray, rate: int = 1) -> DataFrame:
    """(place, lead, ids): all windows of every text, or one in ``rate``; a place is a hash of text and window.

    ``ids`` are 16-bit ranks; the first ``lead`` of them are context, none at the beginning of a text.
    Windows meet without overlap apart from that, so each id of a text is learned from once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, short = Subwords(ranks.value), rank.astype(np.uint16)
        for piece in pieces(batches, "text", SCORED_BYTES):
            _, _, _, ids, begin = _stream(piece.column("text"), subwords)
            end = np.append(begin[1:], len(ids))
            many = -(-(end - begin) // WINDOW)
            row = np.repeat(np.arange(len(many)), many)
            k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            h = piece.column("h").to_numpy().astype(np.uint64)[row]
            if rate > 1:
                some = (h + k.astype(np.uint64)) % np.uint64(rate) == 0
                row, k, h = row[some], k[some], h[some]
            lead = np.minimum(k * WINDOW, LEAD)
            first = begin[row] + k * WINDOW
            last = np.minimum(first + WINDOW, end[row])
            place = (h + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**63 - 1)
            stream = short[ids]
            blobs = [stream[a:b].tobytes() for a, b in zip((first - lead).tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int64)), pa.array(lead, pa.int32()), pa.array(blobs, pa.binary())], names=["place", "lead", "ids"]
            )

    rows = bounded_batches(texts.select(F.xxhash64("doc_id", "text").alias("h"), "text"))
    return rows.mapInArrow(run, "place long, lead int, ids binary")


def _offsets() -> np.ndarray:
    """How far back each of the 2 * BLOCK keys of a block is from each query; negative: later."""
    return BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]


@dataclass
class CausalAttention:
    """x = E[id before]; o = attention over x; h = relu([x, o] Wh); class by h W1, id by h W2[class]."""

    p: dict[str, np.ndarray]
    #: The rank of the end, which stands before every text too.
    end: int = 0

    @staticmethod
    def new(counts: np.ndarray, end: int = 0, seed: int = 11) -> CausalAttention:
        """Untrained weights whose predictions are the counts of the ranked ids."""
        rng = np.random.default_rng(seed)
        part = np.zeros(TOP + 1)
        part[: min(TOP, len(counts))] = counts[:TOP]
        part[TOP] = counts[TOP:].sum()
        part = np.log((part + 1) / (part + 1).sum())
        inner = part[:TOP].reshape(CLASSES - 1, MEMBERS)
        outer = np.append(np.log(np.exp(inner).sum(axis=1)), part[TOP])
        p = {
            "E": rng.normal(0, 0.5, (ROWS, WIDTH)),
            "QKV": rng.normal(0, WIDTH**-0.5, (WIDTH, 3 * WIDTH)),
            "far": np.zeros(2 * BLOCK),
            "Wh": rng.normal(0, (2 * WIDTH) ** -0.5, (2 * WIDTH, HIDDEN)),
            "bh": np.full(HIDDEN, 0.1),
            "W1": rng.normal(0, 0.01, (HIDDEN, CLASSES)),
            "b1": outer,
            "W2": rng.normal(0, 0.01, (CLASSES - 1, HIDDEN, MEMBERS)),
            "b2": inner - np.log(np.exp(inner).sum(axis=1, keepdims=True)),
        }
        return CausalAttention({k: v.astype(np.float32) for k, v in p.items()}, end)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set(self, values: np.ndarray) -> CausalAttention:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def hidden(self, before: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """What ``states`` has, of weights that change.

        ``before``: BLOCK + n embedding rows, the first BLOCK as context; ``start``: where the text of each of the n begins.
        """
        return self.states(self.tables(), before, start)

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Natural logarithms for target ranks; ``tail``: those of ids from TOP on, within the tail."""
        p = self.p
        cls = np.minimum(target // MEMBERS, CLASSES - 1)
        member = (target & (MEMBERS - 1)).astype(np.intp)
        out = np.empty(len(h))
        for a in range(0, len(h), AT_ONCE):
            logits = h[a : a + AT_ONCE] @ p["W1"]
            logits += p["b1"]
            out[a : a + AT_ONCE] = _chosen(logits, cls[a : a + AT_ONCE])
        for c, group in _by_class(cls):
            if c == CLASSES - 1:
                out[group] += tail[target[group] - TOP]
                continue
            for a in range(0, len(group), AT_ONCE):
                rows = group[a : a + AT_ONCE]
                logits = h.take(rows, axis=0) @ p["W2"][c]
                logits += p["b2"][c]
                out[rows] += _chosen(logits, member.take(rows))
        return out

    def tables(self) -> tuple[np.ndarray, ...]:
        """Query, key, value and share of the hidden layer of every embedding row: scoring looks them up."""
        p = self.p
        q, k, v = (np.ascontiguousarray(x) for x in np.split(p["E"] @ p["QKV"], 3, axis=1))
        return q * np.float32(WIDTH**-0.5), k, v, p["E"] @ p["Wh"][:WIDTH] + p["bh"]

    def states(self, tables: tuple[np.ndarray, ...], before: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """``h``, the hidden layer of the n positions of ``hidden``, and what it comes from; the others are padded to whole blocks."""
        q, k, v, own = tables
        n = len(before) - BLOCK
        blocks = -(-n // BLOCK)
        spare = BLOCK * blocks - n
        if spare:
            before, start = np.append(before, np.zeros(spare, before.dtype)), np.append(start, np.zeros(spare, start.dtype))
        start = start.reshape(blocks, BLOCK)
        here = before[BLOCK:]
        q = q.take(here, axis=0).reshape(blocks, BLOCK, WIDTH)
        k, v = _pairs(k.take(before, axis=0)), _pairs(v.take(before, axis=0))
        a = q @ k.transpose(0, 2, 1)
        self._weigh(a, start)
        o = (a @ v).reshape(-1, WIDTH)
        h = o @ self.p["Wh"][WIDTH:]
        h += own.take(here, axis=0)
        np.maximum(h, 0, out=h)
        return {"before": before, "q": q, "k": k, "v": v, "a": a, "o": o, "h": h[:n]}

    def _weigh(self, a: np.ndarray, start: np.ndarray) -> None:
        """Turn scores of keys into attention weights, in place: none for later tokens and other texts."""
        back, blocks = _offsets(), len(a)
        if a.max() > MOST_LOGIT:
            np.minimum(a, MOST_LOGIT, out=a)
        np.exp(a, out=a)
        a *= np.where(back < 0, np.float32(0), np.exp(self.p["far"])[np.maximum(back, 0)])
        # Few blocks reach back over the beginning of a text.
        cut = np.flatnonzero(start.max(axis=1) > BLOCK * np.arange(blocks))
        a[cut] *= (np.arange(2 * BLOCK) + BLOCK * cut[:, None, None]) >= start[cut][:, :, None]
        a /= (a @ _ONES)[:, :, None]

    def gradient(self, before: np.ndarray, start: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of the targets with weight 1; the tail's inner step isn't trained."""
        p, f = self.p, self.hidden(before, start)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        cls = np.minimum(target // MEMBERS, CLASSES - 1)
        # Learned rows by class, the tail last: products of members are slices, everything else is done at once.
        own = np.flatnonzero(weight)
        order = own[np.argsort(cls[own].astype(np.uint8), kind="stable")]
        n = len(order)
        h, cls, member = f["h"].take(order, axis=0), cls[order], target[order] % MEMBERS
        edges = np.searchsorted(cls, np.arange(CLASSES)).tolist()
        groups = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES - 1) if edges[c] < edges[c + 1]]
        top = edges[-1]
        d = h @ p["W1"]
        d += p["b1"]
        _shares(d)
        d[np.arange(n), cls] -= 1
        g["W1"], g["b1"] = h.T @ d, _ones(n) @ d
        dh = d @ p["W1"].T
        d = p["b2"].take(cls[:top], axis=0)
        for c, some in groups:
            d[some] += h[some] @ p["W2"][c]
        _shares(d)
        d[np.arange(top), member[:top]] -= 1
        for c, some in groups:
            np.matmul(h[some].T, d[some], out=g["W2"][c])
            np.matmul(_ones(len(d[some])), d[some], out=g["b2"][c])
            dh[some] += d[some] @ p["W2"][c].T
        dh *= h > 0
        ordered = dh
        dh = np.zeros((len(f["o"]), HIDDEN), np.float32)
        dh[order] = ordered
        x = p["E"].take(f["before"], axis=0)
        g["Wh"][:WIDTH], g["Wh"][WIDTH:], g["bh"] = x[BLOCK:].T @ dh, f["o"].T @ dh, _ones(len(dh)) @ dh
        blocks = len(dh) // BLOCK
        do = (dh @ p["Wh"][WIDTH:].T).reshape(blocks, BLOCK, WIDTH)
        a, q, k, v = f["a"], f["q"], f["k"], f["v"]
        ds = do @ v.transpose(0, 2, 1)
        ds -= (do.reshape(-1, WIDTH) * f["o"] @ _ones(WIDTH)).reshape(blocks, BLOCK, 1)
        ds *= a
        back = _offsets()
        np.add.at(g["far"], np.maximum(back, 0), np.where(back < 0, 0, (_ones(blocks) @ ds.reshape(blocks, -1)).reshape(back.shape)))
        dqkv = np.zeros((len(x), 3 * WIDTH), np.float32)
        np.multiply((ds @ k).reshape(-1, WIDTH), np.float32(WIDTH**-0.5), out=dqkv[BLOCK:, :WIDTH])
        for at, parts in ((WIDTH, ds.transpose(0, 2, 1) @ q), (2 * WIDTH, a.transpose(0, 2, 1) @ do)):
            dqkv[: blocks * BLOCK, at : at + WIDTH] += parts[:, :BLOCK].reshape(-1, WIDTH)
            dqkv[BLOCK:, at : at + WIDTH] += parts[:, BLOCK:].reshape(-1, WIDTH)
        g["QKV"] = x.T @ dqkv
        dx = dqkv @ p["QKV"].T
        dx[BLOCK:] += dh @ p["Wh"][:WIDTH].T
        order = np.argsort(f["before"].astype(np.uint16), kind="stable")
        sorted_rows = f["before"][order]
        fresh = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
        g["E"][sorted_rows[fresh]] = np.add.reduceat(dx.take(order, axis=0), fresh, axis=0)
        for values in g.values():
            values *= np.float32(1 / max(1, n))
        return g

    def fit(self, windows: list[tuple[int, np.ndarray]], rate: float) -> int:
        """One pass of Adam over (lead, ranks) windows in their order; the tokens learned from."""
        w = self.flat()
        m, v = np.zeros_like(w), np.zeros_like(w)
        sizes = np.cumsum([len(ids) for _, ids in windows])
        total, t = 0, 0
        for some in np.split(np.arange(len(windows)), np.flatnonzero(np.diff(sizes // BATCH_TOKENS)) + 1):
            if not len(some):
                continue
            target = np.concatenate([windows[i][1] for i in some]).astype(np.int64)
            lengths = np.array([len(windows[i][1]) for i in some])
            first = np.cumsum(lengths) - lengths
            weight = np.ones(len(target), np.float32)
            before = np.append(self.end, target[:-1])
            before[first] = self.end
            for at, i in zip(first, some):
                weight[at : at + windows[i][0]] = 0
            start = np.repeat(first, lengths) + BLOCK
            rows = np.append(np.zeros(BLOCK, np.int64), embedding_rows(before))
            t += 1
            total += int(weight.sum())
            g = np.concatenate([x.ravel() for x in self.gradient(rows, start, target, weight).values()])
            m += np.float32(0.1) * (g - m)
            g *= g
            v += np.float32(0.01) * (g - v)
            np.sqrt(v, out=g)
            g *= np.float32((1 - 0.99**t) ** -0.5)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= np.float32(rate / (1 - 0.9**t))
            w -= g
            self.set(w)
        return total

    def score(self, target: np.ndarray, first: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Natural log-probability of every rank of a stream of texts that begin at ``first``."""
        n = len(target)
        before = np.append(self.end, target[:-1])
        before[first] = self.end
        rows = np.append(np.zeros(BLOCK, np.int64), embedding_rows(before))
        start = np.repeat(first, np.diff(np.append(first, n)))
        out, tables = np.empty(n), self.tables()
        h = np.empty((min(n, CLASSED_AT_ONCE), HIDDEN), np.float32)
        for a in range(0, n, AT_ONCE):
            b = min(n, a + AT_ONCE)
            at = a % CLASSED_AT_ONCE
            h[at : at + b - a] = self.states(tables, rows[a : b + BLOCK], np.maximum(start[a:b] - a + BLOCK, 0))["h"]
            if b == n or b % CLASSED_AT_ONCE == 0:
                some = slice(b - (at + b - a), b)
                out[some] = self.log_probabilities(h[: at + b - a], target[some], tail)
        return out


def embedding_rows(ranks: np.ndarray) -> np.ndarray:
    return np.where(ranks < TOP, ranks, TOP + ranks % (ROWS - TOP))


def _pairs(x: np.ndarray) -> np.ndarray:
    """Every block of rows together with the one before it, without copying."""
    x = np.ascontiguousarray(x)
    shape = (len(x) // BLOCK - 1, 2 * BLOCK, x.shape[1])
    return np.lib.stride_tricks.as_strided(x, shape, (BLOCK * x.strides[0], *x.strides))


def _ones(n: int) -> np.ndarray:
    """Sums as products with ones take a fraction of the time of sums."""
    return np.ones(n, np.float32)


def _shares(logits: np.ndarray) -> None:
    """Turn each row into its softmax, in place; logits over MOST_LOGIT count as it."""
    if logits.size and logits.max() > MOST_LOGIT:
        np.minimum(logits, MOST_LOGIT, out=logits)
    np.exp(logits, out=logits)
    logits /= (logits @ _ONES)[:, None]


def _chosen(logits: np.ndarray, column: np.ndarray) -> np.ndarray:
    """One column of each row's log-softmax; logits over MOST_LOGIT count as it."""
    if logits.max() > MOST_LOGIT:
        np.minimum(logits, MOST_LOGIT, out=logits)
    out = logits[np.arange(len(logits)), column]
    return out - np.log(np.exp(logits, out=logits) @ _ONES)


def _by_class(cls: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if edges[c] < edges[c + 1]:
            yield c, order[edges[c] : edges[c + 1]]


@dataclass
class Ids:
    """The ids by rank: counts of subwords in all training texts decide it."""

    rank: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Ids:
        order = np.lexsort((np.arange(len(counts)), -counts))
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        return Ids(rank, counts[order])

    def tail(self) -> np.ndarray:
        some = self.counts[TOP:] + 1.0
        return np.log(some / some.sum())


def _mean(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of one part of the weights over all tasks, by the tokens they learned from."""
    total, tokens = 0.0, 0
    for batch in batches:
        for blob, n in zip(batch.column("weights"), batch.column("tokens").to_pylist()):
            total = total + np.frombuffer(blob.as_buffer(), np.float32).astype(np.float64) * n
            tokens += n
    mean = pa.array([(total / tokens).tobytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), mean], names=["part", "weights"])


def trained(windows: DataFrame, ids: Ids, rounds: int = ROUNDS, rate: float = 0.04) -> CausalAttention:
    """The attention model after ``rounds`` rounds over written windows (place, lead, ids).

    A round takes its share of the windows; each task learns from its own, in the order of their
    places, and the weights are averaged by the tokens learned from. A lost task learns the same again.
    """
    model = CausalAttention.new(ids.counts, int(ids.rank[-1]))
    size = windows.agg(F.sum(F.octet_length("ids") / 2)).first()[0] or 0
    tasks = max(1, round(size / rounds / TRAINER_TOKENS))
    for r in range(rounds):
        weights, speed, end = model.flat(), rate / (1 + r), model.end

        def run(batches: Iterator[pa.RecordBatch], weights=weights, speed=speed, end=end) -> Iterator[pa.RecordBatch]:
            own = [
                (lead, np.frombuffer(blob, np.uint16))
                for batch in batches
                for lead, blob in zip(batch.column("lead").to_pylist(), batch.column("ids").to_pylist())
            ]
            keep_freed()
            if own:
                here = CausalAttention.new(np.zeros(0), end).set(weights)
                tokens = here.fit(own, speed)
                parts = [part.tobytes() for part in np.split(here.flat(), range(PART, len(weights), PART))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([tokens] * len(parts), pa.int64())],
                    names=["part", "weights", "tokens"],
                )
            give_back()

        some = windows.where(F.pmod(F.xxhash64("place"), F.lit(rounds)) == r)
        dealt = some.repartition(tasks, "place").sortWithinPartitions("place", "lead", "ids")
        learned = dealt.mapInArrow(run, "part int, weights binary, tokens long")
        # As many values as the model has weights.
        means = learned.groupBy("part").applyInArrow(_mean, "part int, weights binary").collect()
        if means:
            model.set(np.concatenate([np.frombuffer(r["weights"]) for r in sorted(means)]))
    return model


@dataclass
class LanguageModel:
    """What scoring needs: the model, ranked ids, merges, and word counts with their totals."""

    attention: CausalAttention
    ids: Ids
    ranks: dict[bytes, int]
    words: DataFrame
    tokens: int
    kinds: int


def learned(texts: DataFrame, vocabulary: str = VOCABULARY, rate: int = 1, rounds: int = ROUNDS) -> LanguageModel:
    """A model of the texts (doc_id, text): counts of all words, weights from all windows. Null texts are empty.

    A caller's ``rate`` above 1 trains the weights on one in so many windows only.
    """
    context = texts.sparkSession.sparkContext
    ranks = Subwords.read(vocabulary)
    sent = context.broadcast(ranks)
    words = written(word_counts(texts), "lm-words")
    totals = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    ids = Ids.of(subword_counts(words, sent))
    windows = written(training_windows(texts, sent, ids.rank, rate), "lm-windows")
    return LanguageModel(trained(windows, ids, rounds), ids, ranks, words, totals[0] or 0, totals[1])


def _frequent(words: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` words with their counts, the most frequent."""
    step = F.floor(F.log2("n") * 8)
    # A few hundred rows: counts have at most 63 bits.
    sizes = sorted((r["step"], r["kinds"]) for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("kinds")).collect())
    least, total = None, 0
    while sizes and total + sizes[-1][1] <= most:
        least, kinds = sizes.pop()
        total += kinds
    return [(r["word"], r["n"]) for r in words.where(step >= least).collect()] if total else []


def scored(docs: DataFrame, model: LanguageModel, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs``, whole texts.

    Null texts are empty: they have an end only. Repeated rows have a row each; other columns go.
    ``base_score`` is that of unigram counts with one added, ``score`` the attention model's, both log10.
    """
    context = docs.sparkSession.sparkContext
    known = _frequent(model.words, sent_words)
    sent = context.broadcast((model.ranks, [w for w, _ in known], np.array([n for _, n in known], np.int64)))
    attention, rank, tail = model.attention, model.ids.rank, model.ids.tail()
    below = model.tokens + model.kinds + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        ranks, known, times = sent.value
        subwords, known = Subwords(ranks), pa.array(known, pa.string())
        for piece in pieces(batches, "text", SCORED_BYTES):
            rows = piece.num_rows
            kinds, index, sizes, ids, begin = _stream(piece.column("text"), subwords)
            last = len(kinds) - 1
            first = np.cumsum(sizes) - sizes
            counts = np.append(times, 0)[pc.index_in(kinds, value_set=known).fill_null(len(times)).to_numpy()]
            base = np.where(counts > 0, np.log10((counts + 1) / below), 0.0)[index]
            counts = counts[index]
            score = attention.score(rank[ids], begin, tail) / math.log(10)
            # Words that weren't sent: their counts, if any, come by a join.
            rare = np.flatnonzero(counts == 0)
            pair, often = np.unique(np.repeat(np.arange(rows), sizes)[rare] * (last + 1) + index[rare], return_counts=True)
            words = kinds.take(pa.array(pair % (last + 1)))
            lists = pa.array(np.searchsorted(pair // (last + 1), np.arange(rows + 1)), pa.int32())
            struct = pa.StructArray.from_arrays([words, pa.array(often, pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("row"),
                    piece.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(base, first)),
                    pa.array(np.add.reduceat(score, begin)),
                    pa.ListArray.from_arrays(lists, struct),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word string, times long>>"
    rows = bounded_batches(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    # Written, so that a row keeps its number whatever task is repeated.
    found = written(rows.mapInArrow(run, schema), "lm-scores")
    rare = found.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.times")
    n = F.coalesce("n", F.lit(0))
    more = rare.join(model.words, "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((n + 1) / below)).alias("more_base")
    )
    return found.join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learned(docs.where(~held_out()))
    return scored(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
