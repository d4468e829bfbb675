"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train a numpy classifier: the risk of the unlabelled
text, less the share of it that the class prior says is toxic, stands for the risk of clean text,
and may not fall below zero. Features are the starts of words and whole words, as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fold, tidy

#: Lengths in bytes of the word starts that are features.
STARTS = (4, 5, 6, 8)
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, np.uint64)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD[_b] = _b
for _b in range(65, 91):
    _WORD[_b] = _b + 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]))
    return _powers["up"][:n], _powers["down"][:n]


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word's first byte, hash) of every feature of the words in `data` (bytes)."""
    x = _WORD[data]
    edge = np.diff(np.concatenate([[0], (x > 0).view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(x) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(x * up[: len(x)])])
    at, found = [start], [((total[stop] - total[start]) * down[start]) * np.uint64(2) + np.uint64(1)]
    for n in STARTS:
        s = start[stop - start >= n]
        at.append(s)
        found.append(((total[s + n] - total[s]) * down[s] + np.uint64(n)) * np.uint64(2))
    h = np.concatenate(found)
    h ^= h >> np.uint64(29)
    h *= _BASE
    h ^= h >> np.uint64(32)
    return np.concatenate(at), h


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, first byte of each text in them, number of the first text): whole texts, about PIECE
    bytes at a time; a longer text comes in several pieces, cut between words where there is a blank."""
    held, starts, first, size = [], [], 0, 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass") + b"\n"
        while len(data) > PIECE:
            if held:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(starts), first
                held, starts, size = [], [], 0
            end = data.rfind(b" ", 0, PIECE) + 1 or PIECE
            yield np.frombuffer(data[:end], np.uint8), np.array([0]), k
            data = data[end:]
        if size + len(data) > PIECE and held:
            yield np.frombuffer(b"".join(held), np.uint8), np.array(starts), first
            held, starts, size = [], [], 0
        if not held:
            first = k
        held.append(data)
        starts.append(size)
        size += len(data)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(starts), first


class Lexicon:
    """A sorted array of feature hashes, and which of them each text has."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(np.asarray(known, np.uint64))
        self.flag = np.zeros(1 << 20, bool)
        self.flag[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, place of the feature), each pair once."""
        pairs = [np.zeros(0, np.int64)]
        width = max(1, len(self.known))
        for data, starts, first in _pieces(texts) if len(self.known) else ():
            at, h = hashes(data)
            hit = np.flatnonzero(self.flag[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at, h = at[hit], h[hit]
            place = np.searchsorted(self.known, h)
            place[place == len(self.known)] = 0
            good = self.known[place] == h
            text = np.searchsorted(starts, at[good], "right") - 1 + first
            pairs.append(np.unique(text * width + place[good]))
        both = np.unique(np.concatenate(pairs))
        return both // width, both % width


def _documents(texts: list[str], only: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of texts that have it)."""
    if only is not None:
        place = only.present(texts)[1]
        return only.known, np.bincount(place, minlength=len(only.known))
    found = []
    for text in texts:
        own = [hashes(data)[1] for data, _, _ in _pieces([text])]
        found.append(np.unique(np.concatenate(own)))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def select(toxic: list[str], unlabelled: list[str], prior: float, least: float = 0.01, most: int = 2048, z: float = 3.0, share: float = 0.25) -> np.ndarray:
    """Hashes that a share of at least `least` of the toxic texts have (and four of them; copies of
    a text count once), that are more common in these by `z` standard
    errors and that by the class prior are toxic in `share` of their texts; the `most` clearest."""
    toxic, unlabelled = sorted(set(toxic)), sorted(set(unlabelled))
    h, p = _documents(toxic)
    enough = p >= max(3, least * len(toxic))
    h, p = h[enough], p[enough]
    lexicon = Lexicon(h)
    u = _documents(unlabelled, lexicon)[1]
    a, b = max(1, len(toxic)), max(1, len(unlabelled))
    both = (p + u) / (a + b)
    score = (p / a - u / b) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / a + 1 / b))
    keep = np.argsort(-score, kind="stable")[:most]
    return lexicon.known[keep[(score[keep] >= z) & (prior * p[keep] / a >= share * u[keep] / b)]]


def _dense(lexicon: Lexicon, texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), len(lexicon.known)), np.float32)
    x[lexicon.present(texts)] = 1
    return x


def train(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with sigmoid loss, by Adam.

    Where the corrected risk of clean text is negative, a step raises it instead of lowering the
    whole risk. Features start with the same weight, as they were selected for toxic text.
    """
    w = np.full(xp.shape[1] + 1, 3.0)
    w[-1] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        dp, du = prior * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        g = np.append(du @ xu - dp @ xp, du.sum() - dp.sum())  # of the clean risk
        g = g - np.append(dp @ xp, dp.sum()) if su.mean() >= prior * sp.mean() else -g
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(toxic: list[str], unlabelled: list[str], prior: float) -> tuple[Lexicon, np.ndarray, float]:
    prior = min(max(prior, 1e-4), 0.99)
    lexicon = Lexicon(select(toxic, unlabelled, prior))
    if not toxic or not unlabelled:
        return lexicon, np.zeros(len(lexicon.known)), float(np.log(prior / (1 - prior)))
    return lexicon, *train(_dense(lexicon, toxic), _dense(lexicon, unlabelled), prior)


def scores(model: tuple[Lexicon, np.ndarray, float], texts: list[str | None]) -> np.ndarray:
    lexicon, weights, bias = model
    text, place = lexicon.present(texts)
    return 1 / (1 + np.exp(-np.clip(bias + np.bincount(text, weights[place], len(texts)), -500, 500)))


def sample(docs: DataFrame, rows: int, of: DataFrame | None = None) -> list[str]:
    """Whole texts of the first `rows` rows of `docs` by the hash of their ids; of the ids in `of`
    alone, if there is one. Ids are picked first; only picked texts move."""
    slim = docs.filter("text is not null").select("doc_id")
    if of is not None:
        slim = slim.join(of, "doc_id", "left_semi")
    ids = sorted({r["doc_id"] for r in slim.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()})
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    found = docs.filter("text is not null").join(F.broadcast(wanted), "doc_id").select("doc_id", "text").collect()
    return [r["text"] for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))]


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 1500, threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Learns from the whole texts of `rows` toxic documents and three times as many documents of any kind at
    most, none of them held out (crc32 of the id as text, mod 4, is 2); the
    prior is the toxic share of the labels that aren't held out. A null or empty text has no
    features and scores the bias. Without labels all score the smallest prior. An id with two labels
    is toxic if one says so; a null id isn't held out. An empty table gives no rows.
    """
    own = labels.filter((fold(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = own.agg(F.avg("toxic")).first()[0] or 0.0
    free = docs.filter((fold(F.col("doc_id"), 4) != 2) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    marked = own.filter("toxic = 1").select("doc_id")
    toxic = sample(free, rows, marked)
    # unlabelled text is drawn from all documents, so that the prior holds for it
    model = fit(toxic, sample(free, 3 * rows), prior)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores(model, b["text"].tolist())})

    found = docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out")).mapInPandas(tidy(run), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
