"""Embedding distinct texts in parallel, by any model that turns a list of texts into vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Texts in a model call.
BATCH = 16


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class FakeEmbedder:
    """Vectors that follow from a hash of the text alone; for tests, never graded."""

    def __init__(self, dim: int = 16):
        self.dim, self.model_id = dim, f"fake-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = [np.frombuffer(hashlib.shake_256(t.encode()).digest(4 * self.dim), "<u4") for t in texts]
        return (np.array(raw, np.float64).reshape(len(texts), self.dim) / 0xFFFFFFFF).astype(np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed([text])[0]


def embedded(pending: DataFrame, embedder: Embedder) -> DataFrame:
    """The embeddings table of pending (text_hash, text): each distinct hash once, BATCH texts a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), BATCH):
                some = b.iloc[i : i + BATCH]
                yield pd.DataFrame({"text_hash": some["text_hash"], "vector": list(embedder.embed(some["text"].tolist()).astype(np.float32))})

    return pending.dropDuplicates(["text_hash"]).select("text_hash", "text").mapInPandas(run, "text_hash string, vector array<float>")


def slices_agree(texts: DataFrame, embedder: Embedder, sizes: tuple[int, ...] = (1, 2, 7, BATCH)) -> DataFrame:
    """(text_hash, largest) of texts (text_hash, text): the largest difference of a text's vector, in any of its dimensions, between
    being embedded alone and in slices of each of `sizes`. A model that pads its batches soundly has none to speak of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = b["text"].tolist()
            alone = np.concatenate([embedder.embed([t]) for t in told]) if told else np.zeros((0, embedder.dim))
            most = np.zeros(len(told))
            for size in sizes:
                sliced = [embedder.embed(told[k : k + size]) for k in range(0, len(told), size)]
                most = np.maximum(most, np.abs(np.concatenate(sliced or [alone]).astype(np.float64) - alone).max(axis=1, initial=0))
            yield pd.DataFrame({"text_hash": b["text_hash"], "largest": most})

    return texts.dropDuplicates(["text_hash"]).select("text_hash", "text").mapInPandas(run, "text_hash string, largest double")
