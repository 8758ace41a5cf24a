"""Embedding providers: a text column in, vectors out, batch by batch on the executors."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    model_name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Deterministic vectors from hashed words: for tests, and where no model server is."""

    model_name = "hashing"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out


class HttpProvider:
    """A model server that embeds one prompt a request; a batch's requests run together, in order."""

    def __init__(self, url: str, model_name: str, dimensions: int, batch: int = 20):
        self.url, self.model_name, self.dimensions, self.batch = url.rstrip("/"), model_name, dimensions, batch

    def _one(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model_name, "prompt": text}).encode()
        request = urllib.request.Request(f"{self.url}/api/embeddings", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as reply:
            return json.load(reply)["embedding"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        with ThreadPoolExecutor(self.batch) as pool:
            return list(pool.map(self._one, texts))


def token_count(text: str) -> int:
    """Pieces between runs of white space; an empty text has one."""
    return len(text.split()) + (text[:1].isspace() or not text) + (bool(text.strip()) and text[-1:].isspace())


def embedded(texts: DataFrame, provider: Provider) -> DataFrame:
    """(chunk_id, embedding, model_name, dimensions, created_at) from (chunk_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "embedding": provider.embed(batch["text"].tolist())})

    found = texts.select("chunk_id", "text").mapInPandas(run, "chunk_id string, embedding array<float>")
    return found.select(
        "chunk_id",
        "embedding",
        F.lit(provider.model_name).alias("model_name"),
        F.size("embedding").alias("dimensions"),
        F.current_timestamp().alias("created_at"),
    )
