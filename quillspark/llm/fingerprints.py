"""Document fingerprints: SimHash of weighted terms, and permuted block tables to search them.

DataFrame functions only. A term is a pair of successive words, its weight its length times how
often it occurs; each term's hash votes with that weight on 64 signed bits. For a radius r the 64
bits are cut into r + 2 blocks or more; fingerprints within the radius agree on all but r of the
blocks, so one table for each choice of blocks, keyed by their bits, finds them all.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import by_ranges, cut, hex64

_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """Array of (a, b): each word, lower-cased, with the next; the last word with null."""
    words = F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.lit(1), F.size(words) - 1)).alias("b"))


def _votes() -> list[Column]:
    """Sums over the terms (h, w): the whole weight, and 32 sums that hold two bits' votes each."""
    lanes = [F.sum(F.col("w") * F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES))).alias(f"v{k}") for k in range(32)]
    return [F.sum("w").alias("w"), *lanes]


def _fingerprint() -> Column:
    """Bit k is set if terms of over half the weight have it."""
    low = [(F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("w"), k) for k in range(32)]
    high = [(F.shiftrightunsigned(f"v{k}", 32) * 2 > F.col("w"), k + 32) for k in range(32)]
    bits = [F.when(on, F.lit((1 << k) - (1 << 64 if k == 63 else 0))).otherwise(F.lit(0)) for on, k in low + high]
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp): the fingerprint of each row of `texts`, whose `keys` are unique. No words: 0."""
    t = texts.select(*keys, F.inline(terms(F.coalesce(text, F.lit(""))))).toDF(*keys, "a", "b")
    t = t.select(*keys, F.xxhash64("a", "b").alias("h"), (F.length("a") + F.coalesce(F.length("b"), F.lit(0))).cast("long").alias("w"))
    return t.groupBy(*keys).agg(*_votes()).select(*keys, _fingerprint().alias("fp"))


def with_next(docs: DataFrame) -> DataFrame:
    """(part, at, ghost, doc_id, text, next): each row of `docs` (doc_id, text) with the text of the
    next by ascending doc_id, after the last the first.

    Ids are cut into ranges; each range gets a copy (ghost) of the first row of the next range, so
    that a window within the range finds every successor and texts are shuffled once.
    """
    rows = by_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    heads = rows.groupBy("part").agg(F.min("key").alias("key"))  # one row a range
    by = W.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("key").over(by), F.first("key").over(by)).alias("head"))
    ghosts = rows.drop("part").join(F.broadcast(heads), F.col("key") == F.col("head")).groupBy("part").agg(F.min_by(F.struct("doc_id", "text", "key"), F.xxhash64("text")).alias("g"))
    all_rows = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts.select("part", "g.*").withColumn("ghost", F.lit(1)))
    order = W.partitionBy("part").orderBy("ghost", "key", F.xxhash64("text"))
    return all_rows.select("part", F.row_number().over(order).alias("at"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """`text` with its last quarter (rounded down) replaced by as many first code points of `following`."""
    n = F.length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - q), F.substring(following, F.lit(1), q))


def _blocks(count: int) -> list[tuple[int, int]]:
    cuts = [round(i * 64 / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(classes: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (a, b) of `classes` (fp long, distinct) within `radius` bits, once each."""
    cuts = _blocks(blocks)
    masks = [((1 << n) - 1) << first for first, n in cuts]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = list(combinations(range(blocks), blocks - radius))
    whole = [sum(masks[i] for i in t) for t in tables]
    keys = [F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for n, m in enumerate(whole)]
    index = classes.select("fp", F.explode(F.array(*keys)).alias("e")).select("fp", "e.t", "e.k")
    a, b = index.alias("a"), index.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = [x.bitwiseAND(F.lit(m)) == 0 for m in signed]
    # a pair that meets in several tables counts in the first of them only
    first = reduce(lambda chain, n: F.when(reduce(Column.__and__, [same[i] for i in tables[n]]), F.lit(n)).otherwise(chain), reversed(range(len(tables))), F.lit(-1))
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= radius) & (F.col("a.t") == first)
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(x.bitwiseXOR(y)) / F.lit(64.0)


def document_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, class_id (smallest doc_id with the same
    fingerprint) and n_links (how many other fingerprints lie within `radius` bits).

    A null text is empty, an empty text has fingerprint zero, and equal texts have equal
    fingerprints. Rows with equal doc_ids follow each other by the hash of their texts; a null
    doc_id comes first. A single row is its own successor. An empty table gives no rows.
    """
    rows = with_next(docs)
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, edited(F.col("text"), F.col("next"))))
    rows = rows.select("part", "at", "ghost", "doc_id", F.length("text").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("e"))
    keys = ["part", "at", "ghost", "doc_id", "n_chars", "sha"]
    fps = fingerprint(rows.select(*keys, "e.which", "e.text"), [*keys, "which"])
    fps = fps.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    fps = fps.withColumn("nfp", F.lead("fp").over(W.partitionBy("part").orderBy("at"))).filter("ghost = 0")
    fps = cut(fps.select("doc_id", "n_chars", "sha", "fp", "efp", "nfp"))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("class_id")))
    found = links(classes, radius).select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = classes.join(found, "fp", "left").select("fp", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return fps.join(named, "fp").select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        hex64(F.col("fp")).alias("fingerprint"),
        hex64(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        "class_id",
        "n_links",
    )
