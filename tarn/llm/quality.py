"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE bytes that together are its whole text. Each passage
is encoded, a gated attention weighs the encodings, and a logistic layer scores their weighted
sum. Only documents carry labels; which passages matter is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import bounded_batches, byte_view, pieces, with_columns, written

PASSAGE = 512
BIGRAMS = 256
FEATURES = 130 + BIGRAMS + 4
#: The model is fitted on so many labelled documents and bytes of text at most; each is taken whole.
FIT_DOCUMENTS = 3_000
FIT_BYTES = 24 << 20
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 20

_SYMBOL = np.minimum(np.arange(256), 129)
_SYMBOL[128:192] = 128
_SYMBOL[192:] = 129
_SYMBOL32 = _SYMBOL.astype(np.int32)


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of each row (every row has one at least).

    Square roots of byte shares and of hashed byte-pair shares, how concentrated both are,
    the passage's length and its share of blanks.
    """
    lengths = np.diff(offsets)
    n = np.maximum(1, -(-lengths // PASSAGE))
    first = np.cumsum(n) - n
    total = int(n.sum())
    where = np.arange(len(data), dtype=np.int32)
    where -= np.repeat(offsets[:-1].astype(np.int32), lengths)
    where //= PASSAGE
    where += np.repeat(first.astype(np.int32), lengths)
    ones = np.bincount(where * 130 + _SYMBOL32[data], minlength=total * 130).reshape(total, 130).astype(np.float32)
    wide = data.astype(np.int32)
    pair = (wide[:-1] * 31 + wide[1:] * 7 + (wide[1:] >> 5)) % BIGRAMS if len(data) else wide
    del wide
    same = where[:-1] == where[1:]
    twos = np.bincount(where[:-1][same] * BIGRAMS + pair[same], minlength=total * BIGRAMS)
    twos = twos.reshape(total, BIGRAMS).astype(np.float32)
    size = np.maximum(ones.sum(axis=1, keepdims=True), 1)
    ones /= size
    twos /= np.maximum(twos.sum(axis=1, keepdims=True), 1)
    more = np.concatenate(
        [
            (ones**2).sum(axis=1, keepdims=True) * 4,
            (twos**2).sum(axis=1, keepdims=True) * 16,
            size / PASSAGE,
            ones[:, 32:33] * 4,
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(ones), np.sqrt(twos), more], axis=1).astype(np.float32), first


def _softmax(logits: np.ndarray, first: np.ndarray, bag: np.ndarray) -> np.ndarray:
    e = np.exp(logits - np.maximum.reduceat(logits, first)[bag])
    return e / np.add.reduceat(e, first)[bag]


class AttentionMIL:
    """h = tanh(xW + b); weights = softmax(w . (tanh(hV) * sigmoid(hU))); score = sigmoid(c . sum + d)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "W": rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)),
            "b": np.zeros(hidden),
            "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "U": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "w": rng.normal(0, gate**-0.5, gate),
            "c": rng.normal(0, hidden**-0.5, hidden),
            "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.mean = np.zeros(FEATURES, np.float32)
        self.scale = np.ones(FEATURES, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sizes = np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), sizes)
        h = np.tanh(x @ p["W"] + p["b"])
        u, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        a = _softmax((u * g) @ p["w"], first, bag)
        z = np.add.reduceat(a[:, None] * h, first)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"bag": bag, "h": h, "u": u, "g": g, "a": a, "z": z, "score": score}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        bag, h, u, g, a = f["bag"], f["h"], f["u"], f["g"], f["a"]
        ds = (f["score"] - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (h * dz[bag]).sum(axis=1)
        dl = a * (da - np.add.reduceat(a * da, first)[bag])
        dug = dl[:, None] * p["w"]
        du, dg = dug * g * (1 - u * u), dug * u * g * (1 - g)
        dh = a[:, None] * dz[bag] + du @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h * h)
        out = {
            "W": x.T @ dpre,
            "b": dpre.sum(axis=0),
            "V": h.T @ du,
            "U": h.T @ dg,
            "w": (u * g).T @ dl,
            "c": f["z"].T @ ds,
            "d": ds.sum(keepdims=True),
        }
        return {k: v + decay * p[k] for k, v in out.items()}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.01) -> AttentionMIL:
        """Full-batch Adam; the same rows in the same order give the same model."""
        self.mean = x.mean(axis=0)
        self.scale = 1 / (x.std(axis=0) + 0.02)
        x = ((x - self.mean) * self.scale).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            for k, g in self.gradient(x, first, y.astype(np.float32), 1e-4).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                self.p[k] = (self.p[k] - step).astype(np.float32)
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(((x - self.mean) * self.scale).astype(np.float32), first)["score"].astype(np.float64)


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS, most_bytes: int = FIT_BYTES) -> AttentionMIL | None:
    """A model of labels.quality from a bounded sample of labelled documents that are not held out.

    The sample is that of the labels of least xxhash64(doc_id): ``limit`` at most, without the
    documents with which the texts would exceed ``most_bytes`` (of documents that all do, the
    shortest is taken); every passage of a sampled text counts. Null keys, qualities and texts
    are left out; repeated labels of a document count by their least value. None without a
    labelled text.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    sample = (
        usable.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    sample = F.broadcast(written(sample, "quality-sample"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(sample, "doc_id")
    sizes = sizes.groupBy("doc_id", "quality").agg(F.sum("bytes").alias("bytes"))
    # At most ``limit`` rows.
    known = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    some, total = [], 0
    for row in known:
        if total + row["bytes"] <= most_bytes:
            some.append(row)
            total += row["bytes"]
    some = some or sorted(known, key=lambda r: r["bytes"])[:1]
    chosen = docs.sparkSession.createDataFrame(some, sizes.schema).select("doc_id", "quality")
    bags = bounded_batches(texts).join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", CHUNK_BYTES):
            x, first = passage_features(*byte_view(piece.column("text")))
            ends = np.append(first[1:], len(x))
            blobs = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first, ends)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), piece.column("quality").cast(pa.int32()), pa.array(blobs, pa.binary())],
                names=["doc_id", "quality", "x"],
            )

    rows = bags.mapInArrow(encode, "doc_id long, quality int, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    bag = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in rows]
    sizes = np.array([len(b) for b in bag])
    y = np.array([r["quality"] for r in rows])
    return AttentionMIL().fit(np.concatenate(bag).astype(np.float32), np.cumsum(sizes) - sizes, y)


def scored(docs: DataFrame, model: AttentionMIL | None, column: str = "quality_score") -> DataFrame:
    """``docs`` with ``column`` added: a score in [0, 1] of every whole text.

    Null texts count as empty, and empty ones are a single blank passage. Without a model all
    score 0.5. An input column of the same name is replaced.
    """
    docs = bounded_batches(docs.drop(column))
    schema = T.StructType(docs.schema.fields + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", CHUNK_BYTES):
            if model is None:
                score = np.full(piece.num_rows, 0.5)
            else:
                score = model.score(*passage_features(*byte_view(piece.column("text"))))
            fields = [piece.schema.field(i) for i in range(piece.num_columns)] + [pa.field(column, pa.float64())]
            yield with_columns(pa.schema(fields), piece, {column: pa.array(score, pa.float64())})

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at ``threshold`` or more, columns as in ``docs``; without labels, all."""
    found = scored(docs, fit(docs, labels), "__quality")
    return found.where(F.col("__quality") >= threshold).select(*docs.columns)


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = scored(docs, fit(docs, labels), "score")
    return found.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
