"""What the corpus operators share: reading tables, cutting lineage, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.store import shared_dir, stored

__all__ = ["shared_dir"]

#: Written as a table in the shared folder and read back.
cut = stored

#: Bytes that end a word: the blank and the five control characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker holds for the next tasks of one operator, each with a clear().
HELD: list[dict] = []


def drop_held() -> None:
    for held in HELD:
        held.clear()


def tidy(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """`run`, a function for mapInPandas or mapInArrow, that gives what it freed back to the system when
    its task ends: Python workers serve one stage after another and would keep it. Unless told to `keep`
    it, what a worker holds for another operator's tasks goes first."""

    def whole(batches: Iterator) -> Iterator:
        if not keep:
            drop_held()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return whole


#: Ranges whose bounds come from the driver, at most, and ranges that each of them is cut into, at most.
MOST_PARTS, MOST_INNER = 8192, 256
#: Rows of a range, about, where there are more rows than a range for each shuffle partition takes.
PART_ROWS = 1 << 15


def by_ranges(rows: DataFrame, name: str, part_rows: int = PART_ROWS, most: int = MOST_PARTS) -> DataFrame:
    """`rows` with key (the long column `name`, null as the smallest long) and part: the number of
    the range of keys it lies in. Ranges hold about as many rows each; there are four for each
    shuffle partition, or more, so that a range has about `part_rows` rows at most. The bounds come from a pass
    over the keys alone. The driver sees those of `most` ranges; where that is too few, each of these is cut
    again, by bounds that stay in a table of one row a range.
    """
    rows = rows.withColumn("key", F.coalesce(name, F.lit(-(1 << 63))))
    wanted = max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.select("key").count() // part_rows))
    parts, inner = min(most, wanted), min(MOST_INNER, -(-wanted // most))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    bounds = sorted(set(cuts or []))
    if not bounds:
        return rows.withColumn("part", F.lit(0))
    at, steps = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    # a binary search: how many bounds are at most the key
    part = F.aggregate(steps, F.lit(0), lambda low, s: F.when((low + s <= len(bounds)) & (F.get(at, low + s - 1) <= F.col("key")), low + s).otherwise(low))
    rows = rows.withColumn("part", part)
    if inner == 1:
        return rows
    (within,) = fresh(rows, "within")
    table = cut(rows.groupBy("part").agg(F.percentile_approx("key", [i / inner for i in range(1, inner)], 20 * inner).alias(within)))
    finer = F.col("part") * inner + F.size(F.filter(F.array_distinct(within), lambda b: b <= F.col("key")))
    # of a proven size: at most `most` rows of MOST_INNER bounds, 16 MB
    return rows.join(F.broadcast(table), "part").withColumn("part", finer).drop(within)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores after it as no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def hex64(fingerprint: Column) -> Column:
    """A 64-bit number as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, mod `of`; a null id: `of`, so in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(of))


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links` (a long, b long): one row (node, component) for each
    linked node, the component being its smallest node.

    Alternates large-star and small-star steps. Each step keeps at most one row per edge, a
    node's minimum is combined before the shuffle, and a node with very many edges meets its
    minimum in a join whose partitions can be split. Rows with a null or with a = b are ignored.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    )
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u > v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
