"""Documents drawn by importance: how much likelier their n-grams are in a target than in the corpus.

Documents are counted in chunks of bounded size. A chunk keeps each of its distinct features once, as a
string, and its documents' counts as places among these. Features of all chunks meet in one dictionary,
where each distinct string is hashed once; buckets add up from there, and a bucket's gain goes back to the
chunks by the feature's string, once a chunk and feature, and so to the documents' counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, tidy
from quillspark.operators.ordering import positions

#: Bytes of text and documents of a chunk, at most; a document of more bytes is a chunk of its own.
CHUNK_BYTES, CHUNK_DOCS = 1 << 24, 1 << 14
_CHUNK = "chunk long, features array<string>, totals array<long>, doc_ids array<long>, n_words array<long>, n_features array<long>, ends array<long>, cells binary"
_SCORED = "row long, doc_id long, n_words long, n_features long, weight long"

# What is no digit, letter or byte of a longer character parts words; A-Z become a-z
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and each one's text, by its number."""
    held = [(t or "").encode().translate(_FOLD) for t in texts]
    own = np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8)
    inside = own != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(own[inside].tobytes()))
    firsts = np.cumsum([1, *(len(h) + 1 for h in held)])[:-1]
    return words, np.searchsorted(firsts, starts, "right") - 1


def _grams(words: pa.Array, of: np.ndarray, low: int, high: int) -> tuple[pa.Array, np.ndarray]:
    """All runs of low to high consecutive words of a text, joined by one blank."""
    runs, texts = [], []
    for n in range(low, high + 1):
        m = max(0, len(words) - n + 1)
        whole = of[:m] == of[n - 1 : n - 1 + m]
        parts = [words.slice(k, m) for k in range(n)]
        run = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        runs.append(run.filter(pa.array(whole)))
        texts.append(of[:m][whole])
    return pa.concat_arrays(runs), np.concatenate(texts)


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Places, as steps from one to the next, and counts, compressed."""
    cells = np.concatenate([np.diff(places, prepend=0), counts]).astype("<i4")
    return len(cells).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(cells, asbytes=True)


def _unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(cells[:8], "little")
    both = np.frombuffer(pa.Codec("zstd").decompress(cells[8:], 4 * n), "<i4") if n else np.zeros(0, np.int32)
    return np.cumsum(both[: n // 2]), both[n // 2 :].astype(np.int64)


def _chunk(chunk: int, doc_ids: pa.Array, texts: list[str | None], low: int, high: int) -> pa.RecordBatch:
    words, of = _words(texts)
    grams, of_gram = (words, of) if low == high == 1 else _grams(words, of, low, high)
    coded = grams.dictionary_encode()
    place, n = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    keys, counts = np.unique(of_gram * n + place, return_counts=True)
    per = lambda x: np.bincount(x, minlength=len(texts))
    cell = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), cell(coded.dictionary.cast(pa.string()), pa.string()), cell(np.bincount(place, minlength=len(coded.dictionary)), pa.int64()), cell(doc_ids, pa.int64()), cell(per(of), pa.int64()), cell(per(of_gram), pa.int64()), cell(np.cumsum(per(keys // n)), pa.int64()), pa.array([_packed(keys % n, counts)], pa.binary())],
        [c.split()[0] for c in _CHUNK.split(", ")],
    )


def chunks(docs: DataFrame, low: int = 1, high: int = 1) -> DataFrame:
    """`docs` (doc_id, text) by chunks: the distinct features of a chunk and how often each occurs, and for
    each document its words, its features and the places and counts of its distinct features, up to `ends`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
            a = 0
            while a < len(batch):
                b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES, "right"))
                b = min(max(a + 1, b), a + CHUNK_DOCS, len(batch))
                yield _chunk(chunk, batch.column("doc_id").slice(a, b - a), batch.column("text").slice(a, b - a).to_pylist(), low, high)
                chunk, a = chunk + 1, b

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), _CHUNK)


def dictionary(chunked: DataFrame) -> DataFrame:
    """(feature, n): each distinct feature string and how often it occurs in all chunks."""
    own = chunked.select(F.explode(F.arrays_zip("features", "totals")).alias("f"))
    return own.groupBy(F.col("f.features").alias("feature")).agg(F.sum("f.totals").alias("n"))


def hashed(features: DataFrame, buckets: int) -> DataFrame:
    """The dictionary with each string's bucket: the unsigned crc32 of its UTF-8 bytes modulo `buckets`."""
    return features.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): a thousand times the log of how much likelier a bucket is in `target` than in `source`,
    both (bucket, n), with one more count everywhere, rounded down. Buckets that neither has aren't there."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    cells = cut(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))  # `buckets` rows at most
    s, t = cells.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = (F.col("t") + 1.0) * F.lit(s + buckets) / ((F.col("s") + 1.0) * F.lit(t + buckets))
    return cells.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight): one row for each of `docs`, `row` being its own number.

    Both tables need text. A null or empty text has no words and the weight 0, as does every document
    where both tables have no features. Repeated rows and null ids are documents like others.
    """
    chunked = cut(chunks(docs, low, high))
    own = cut(hashed(dictionary(chunked), buckets))
    other = hashed(dictionary(chunks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), low, high)), buckets)
    # of a proven size: `buckets` rows
    gain = F.broadcast(gains(own.select("bucket", "n"), other.select("bucket", "n"), buckets))
    valued = own.join(gain, "bucket").select("feature", "gain")
    asked = chunked.select("chunk", F.posexplode("features").alias("place", "feature"))
    # a place and its gain in one number, in order of places; a gain is far from 2^31
    cell = F.shiftleft(F.col("place").cast("long"), 32) + F.col("gain") + (1 << 31)
    back = asked.join(valued, "feature").groupBy("chunk").agg(F.sort_array(F.collect_list(cell)).alias("gains"))
    rows = chunked.drop("features", "totals").join(back, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = lambda name: batch.column(name).slice(k, 1).flatten()  # noqa: E731, B023
                ends, (places, counts) = one("ends").to_numpy(), _unpacked(batch.column("cells")[k].as_py())
                sums = np.zeros(len(places) + 1, np.int64)
                if len(places):
                    gains_of = (one("gains").to_numpy() & 0xFFFFFFFF) - (1 << 31)
                    np.cumsum(gains_of[places] * counts, out=sums[1:])
                weight = sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else ends
                row = np.arange(len(ends), dtype=np.int64) + batch.column("chunk")[k].as_py() * CHUNK_DOCS
                yield pa.RecordBatch.from_arrays([pa.array(row), one("doc_ids"), one("n_words"), one("n_features"), pa.array(weight, pa.int64())], [c.split()[0] for c in _SCORED.split(", ")])

    return rows.mapInArrow(tidy(run), _SCORED)


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths for each id, the same in every run; a null id is written as nothing."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """One row for each of `docs` (doc_id, text): doc_id, n_words, n_features, weight, score and rank.

    score is weight plus Gumbel noise, so that the highest scores are a draw without replacement in proportion
    to the exponential of the weight. Of the documents with at least `least` words, `percent` in a hundred
    (rounded down) get a rank, 1 for the highest score, ties to the smaller doc_id (null first); rank is null for the others.
    Rows that are repeated are ranked each. Null and empty texts have weight 0 and no rank; empty tables give no rows.
    """
    scored = cut(weights(docs, target, low, high, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.filter(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    place = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    out = positions(able, F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row"), name="rank").withColumn("rank", place)
    out = out.unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
