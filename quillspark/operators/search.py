"""Vector search, rank fusion, hybrid search and its note and passage views."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.functions import kernels
from quillspark.functions import text as t
from quillspark.functions.vectors import cosine, squared_l2
from quillspark.operators import lexical
from quillspark.sources.store import stored

KEYS = ["note_path", "seq"]
#: Rows of a stated query set that meet all vectors at once.
QUERY_ROWS = 1024
_NONE = 2147483647


def pool(hits: int) -> int:
    """How many candidates each list brings for so many hits."""
    return min(_NONE, max(30, 5 * hits))


def note_pool(limit: int) -> int:
    return pool(3 * limit)


def passage_pool(limit: int) -> int:
    return pool(limit + 2)


def blocks(queries: DataFrame, key: str, most: int = QUERY_ROWS) -> Iterator[DataFrame]:
    """A stated query set in blocks of about `most` rows, each small enough to broadcast."""
    n = -(-queries.count() // most)
    for block in range(max(1, n)):
        yield queries.filter(F.pmod(F.xxhash64(key), n) == block) if n > 1 else queries


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, note_path, seq, d2, rank from 0): the k exact nearest of vectors (note_path, seq,
    vector) to each query (query_id, query_vector); ties by path and place.

    The queries are a stated set: blocks of about QUERY_ROWS go to all tasks, each against all vectors as a
    matrix product, and every task keeps k rows a query before the shuffle. Null vectors are near nothing.
    """
    order = W.partitionBy("query_id").orderBy("d2", *KEYS)
    rows = vectors.filter("vector is not null").select(*KEYS, "vector").sortWithinPartitions(*KEYS)
    out, schema = None, StructType([queries.schema["query_id"], *[vectors.schema[c] for c in KEYS], StructField("near", DoubleType())])
    for block in blocks(queries, "query_id"):
        asked = block.filter("query_vector is not null").select("query_id", "query_vector").toArrow().combine_chunks()
        kernel = kernels.nearby(pa.array(asked["query_id"]), kernels.matrix(pa.array(asked["query_vector"])), k)
        own = rows.mapInArrow(kernel, schema)
        out = own if out is None else out.unionByName(own)
    best = out.select("query_id", *KEYS, (0.0 - F.col("near")).alias("d2")).withColumn("rank", F.row_number().over(order) - 1)
    return best.filter(F.col("rank") < k)


def nearest_to(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(note_path, seq, d2): the k exact nearest to one vector, without a shuffle but the last merge."""
    at = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(*KEYS, squared_l2(F.col("vector"), at).alias("d2")).orderBy("d2", *KEYS).limit(k)


def fuse(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """(query_id, note_path, seq, score, <name>_rank ...): reciprocal rank fusion of ranked lists
    (query_id, note_path, seq, rank from 0)."""
    rows = None
    for name, ranked in lists.items():
        own = ranked.select("query_id", *KEYS, F.lit(name).alias("list"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    ranks = [F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists]
    # the lists' parts are added in their own order, so that sums agree to the last bit
    fused = rows.groupBy("query_id", *KEYS).agg(*ranks)
    score = sum((F.coalesce(1.0 / (k + F.col(f"{name}_rank") + 1), F.lit(0.0)) for name in lists), F.lit(0.0))
    return fused.withColumn("score", score)


def fused_order(dense: str | None = "vector_rank") -> list[Column]:
    """Score, then the dense rank (none last), then path and place."""
    return [F.desc(F.round("score", 12)), *([F.coalesce(dense, F.lit(_NONE))] if dense else []), *[F.col(c) for c in KEYS]]


def hybrid(postings: DataFrame, stats: DataFrame, vectors: DataFrame | None, queries: DataFrame, width: int, stem: bool = False) -> DataFrame:
    """The `width` best chunks of each query (query_id, query, query_vector) by words and by meaning:
    query_id, note_path, seq, score, bm25_rank, vector_rank, cos, best_cos, rank.

    Without vectors, by words alone, and cos and best_cos are null.
    """
    words = lexical.query_words(queries, stem)
    lists = {"bm25": lexical.best(postings, stats, words, width)}
    if vectors is not None:
        near = stored(nearest(vectors, queries.select("query_id", "query_vector"), width))  # `width` rows a query, read twice
        lists["vector"] = near
    fused = fuse(lists)
    if vectors is None:
        fused = fused.withColumn("vector_rank", F.lit(None).cast("int")).withColumn("cos", F.lit(None).cast("double")).withColumn("best_cos", F.lit(None).cast("double"))
    else:
        fused = fused.join(near.select("query_id", *KEYS, cosine(F.col("d2")).alias("cos")), ["query_id", *KEYS], "left")
        fused = fused.withColumn("best_cos", F.max("cos").over(W.partitionBy("query_id")))
    order = W.partitionBy("query_id").orderBy(*fused_order())
    return fused.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < width)


def _texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hits that still have a chunk, with it. Hits are a few rows a query and go to the chunks, whose texts aren't shuffled."""
    return chunks.join(lexical.small(stored(hits)), KEYS)


def note_view(hits: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """One row per note: query_id, path, title, score, snippet, rank, with the hit's provenance.

    Of each query's hits that still have a chunk, the first 3 * limit count, then each note's
    best, then the first `limit`.
    """
    alive = _texts(hits, chunks.select(*KEYS, "text"))
    by = lambda *k: W.partitionBy(*k).orderBy("rank")
    alive = alive.withColumn("at", F.row_number().over(by("query_id"))).filter(F.col("at") <= 3 * limit)
    best = alive.withColumn("own", F.row_number().over(by("query_id", "note_path"))).filter("own = 1")
    best = best.withColumn("place", F.row_number().over(by("query_id")) - 1).filter(F.col("place") < limit)
    rows = best.join(queries.select("query_id", t.query_terms(F.col("query")).alias("terms")), "query_id")
    return rows.select("query_id", F.col("note_path").alias("path"), t.title(F.col("note_path")).alias("title"), "score", t.snippet(F.col("text"), F.col("terms")).alias("snippet"), F.col("place").alias("rank"), "bm25_rank", "vector_rank", "cos", "best_cos")


def passage_view(hits: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The first `limit` chunks of each query that still exist, with their whole text."""
    alive = _texts(hits, chunks.select(*KEYS, "heading_path", "text"))
    alive = alive.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1).filter(F.col("place") < limit)
    return alive.select("query_id", F.col("note_path").alias("path"), "heading_path", "score", "text", F.col("place").alias("rank"))


def within(vectors: DataFrame, reach: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of notes that `reach` (path) holds; ranks are among these."""
    return nearest(vectors.join(reach.select(F.col("path").alias("note_path")).distinct(), "note_path", "left_semi"), queries, k)


def vector_view(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, path, title, score, rank): the first `limit` notes by their nearest chunk, among the 3 * limit
    nearest chunks; the score is the distance, negative."""
    near = nearest(vectors, queries, 3 * limit)
    best = near.groupBy("query_id", F.col("note_path").alias("path")).agg(F.min_by("d2", "rank").alias("d2"), F.min("rank").alias("at"))
    rows = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("at")) - 1).filter(F.col("rank") < limit)
    return rows.select("query_id", "path", t.title(F.col("path")).alias("title"), (-F.sqrt("d2")).alias("score"), "rank")
