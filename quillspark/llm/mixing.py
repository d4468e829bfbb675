"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counted exactly, a water level gives each source its target, whole repeats of a
source fill most of it, and what remains is filled exactly: a proportional number of documents
of each length, corrected by a bounded-knapsack dynamic program over the last few thousand
words. Where that misses, a program over the whole budget chooses the long documents. Which documents of a length are taken follows from a seed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, cut, fresh

#: Words that the dynamic program fits at most.
WINDOW = 1 << 14
#: Bits that a program over a whole budget holds; it counts in units of so many words that it needs no more.
BITS = 1 << 29
#: Documents of one source and length that are ranked in one group at most, on average.
SALT_ROWS = 4096
#: Rows of a plan, one for each source and length, that are sent to all tasks, at most: about 60 MB.
MOST_SENT = 1 << 20


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but blanks and control characters 9 to 13; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of `sizes` (source, size).

    Sources by code point, null last, get `weights`, repeating; they share the whole size, and a
    target that would pass `most` times its source's size stops there, the rest resharing the
    excess. That is a water level: the target is min(weight * level, most * size), and the level is
    the largest that any prefix of the sources, ordered by size / weight, would leave. One row
    per source is all that the windows see.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    up = W.orderBy("ratio", F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by) - 1) % len(weights) + 1))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(W.partitionBy()) - before) / F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max("level").over(W.partitionBy()))
    return s.select("source", "source_size", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("w") * F.col("level"))).alias("target"))


def _items(lengths: np.ndarray, free: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(index, documents): powers of two and a rest of which any number up to `free` is a sum, shortest first."""
    items = []
    for i in np.argsort(-lengths, kind="stable")[::-1]:
        left, part = int(free[i]), 1
        while left > 0 and 0 < lengths[i] * part <= most:
            n = min(part, left)
            items.append((int(i), n))
            left, part = left - n, part * 2
    return items


def _program(lengths: np.ndarray, free: np.ndarray, goal: int) -> np.ndarray:
    """How many of the `free` documents of each length come nearest to `goal` together."""
    take = np.zeros_like(free)
    most = 2 * goal + 1  # a sum above the goal may be nearer than any below it
    items = _items(lengths, free, most)
    reach, mask, seen = 1, (1 << (most + 1)) - 1, []
    for i, n in items:
        seen.append(reach)
        reach |= (reach << (n * int(lengths[i]))) & mask
        if reach >> goal & 1:
            break
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    over = reach >> (goal + 1)
    above = goal + (over & -over).bit_length() if over else 1 << 62
    at = above if above - goal < goal - below else below
    for (i, n), was in zip(items[: len(seen)][::-1], seen[::-1], strict=True):
        if not was >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take for a total of `budget` words, or as near to it as the
    window and the units allow. `counts` documents there are of each of the distinct `lengths`."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    away = lambda take: abs(int((take * lengths).sum()) - budget)
    take = _fit_window(lengths, counts, budget, window)
    if budget <= 0 or int((lengths * counts).sum()) <= budget or not away(take):
        return take
    return min(take, _fit_whole(lengths, counts, budget, window), key=away)


def _fit_whole(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """The nearest sum of all documents where BITS allow; else long documents are chosen in units of
    several words, for what the short ones leave to them, and the short ones are fitted to the rest."""
    units = lambda some: -(-2 * budget * max(1, len(_items(lengths, some, 2 * budget + 1))) // BITS)
    if units(counts) <= 1:
        return _program(lengths, counts, budget)
    long = lengths > window // 2
    free = np.where(long, counts, 0)
    unit, short = units(free), int((lengths * (counts - free)).sum())
    goal = budget - int(short * (budget / int((lengths * counts).sum())))
    take = _program(np.rint(lengths / unit).astype(np.int64), free, int(round(goal / unit)))
    return take + _fit_window(lengths, counts - free, budget - int((lengths * take).sum()), window)


def _fit_window(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """A proportional number of each length, then the longest that fit, then a program over the last `window` words."""
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    take = np.where(lengths > 0, np.floor(counts * (budget / total)).astype(np.int64), 0)
    left = budget - int((lengths * take).sum())
    while left < 0:  # a rounding in the share
        i = int(np.argmax(take * lengths))
        take[i] -= 1
        left += int(lengths[i])
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if 0 < lengths[i] <= left:
            n = min(int(counts[i] - take[i]), max(1, left // int(lengths[i])) if left > window else 1)
            take[i] += n
            left -= n * int(lengths[i])
    # short documents go back so that the program has something to choose from
    for i in order[::-1]:
        if left >= window // 2:
            break
        if 0 < lengths[i] <= window // 2:
            n = min(int(take[i]), (window // 2 - left) // int(lengths[i]) + 1)
            take[i] -= n
            left += n * int(lengths[i])
    return take + _program(lengths, counts - take, min(left, window))


def _fit_source(rows: pd.DataFrame, most: float = 3.0) -> pd.DataFrame:
    """Adds epochs and pick. Where single documents come no nearer than 0.2 %, documents may come again
    while others don't, up to `most` times in all."""
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    rows = rows.sort_values("size", ignore_index=True)
    epochs = int(target // size) if size else 0
    rest = int(round(target - epochs * size)) if size else 0
    lengths, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    best, pick = epochs, fit(lengths, counts, rest)
    away = lambda base, p: abs(int((p * lengths).sum()) - rest - (epochs - base) * size)
    for base in range(epochs, -1, -1):
        for times in range(2, int(most) - base + 1):
            if away(best, pick) > 0.002 * target:
                again = fit(lengths, times * counts, rest + (epochs - base) * size)
                best, pick = min((best, pick), (base, again), key=lambda x: away(*x))
    return rows.assign(epochs=best, pick=pick)[["source", "size", "n", "epochs", "pick"]]


def _with_plan(rows: DataFrame, plan: DataFrame, count: int, most: int = MOST_SENT, salts: int = 32) -> DataFrame:
    """`rows` (source, size, draw) with their length's row of `plan` (s, z). Up to `most` rows of the plan are sent
    to all tasks; of a longer plan each row meets its documents in `salts` places, so that a length which a third
    of all documents have isn't one key."""
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    if count <= most:
        return rows.join(F.broadcast(plan), on).drop("s", "z")
    plan = plan.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("i", F.pmod(F.shiftright("draw", 7), F.lit(salts)).cast("int"))
    return rows.join(plan.hint("merge"), on & (F.col("i") == F.col("j"))).drop("s", "z", "i", "j")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target,
    taken (words the mix takes of it, repeats counted) and copies (taken / size).

    A null text has size 0; empty texts are taken 0 times. A null source is a source. Repeated rows
    count and are chosen singly. An empty table gives no rows. Other columns are ignored.
    """
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    goals = targets(sizes, weights, most)
    lengths = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    g = goals.select(F.col("source").alias("s"), "source_size", "target")
    plan = cut(
        lengths.join(g, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .groupBy(F.coalesce("source", F.lit("")), F.isnull("source"))
        .applyInPandas(lambda rows: _fit_source(rows, most), "source string, size long, n long, epochs long, pick long")
    )
    whole = F.floor(F.col("pick") / F.col("n"))
    p = plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", (F.col("epochs") + whole).alias("epochs"), (F.col("pick") - whole * F.col("n")).alias("pick"))
    rows = _with_plan(sizes.withColumn("draw", F.xxhash64("doc_id", F.lit(seed))), p, plan.count())
    rows = rows.withColumn("salt", F.pmod("draw", 1 + F.floor(F.col("n") / SALT_ROWS)))
    # in a length with very many documents, each salt gets its share of the count
    big = rows.filter((F.col("n") >= SALT_ROWS) & (F.col("pick") > 0)).groupBy("source", "size", "salt").agg(F.count("*").alias("there"), F.first("pick").alias("of"))
    before = F.coalesce(F.sum("there").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quota = big.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), F.greatest(F.lit(0), F.least("there", F.col("of") - before)).alias("quota"))
    rows = rows.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t")), "left").drop("s", "z", "t")
    rows = rows.withColumn("quota", F.coalesce("quota", F.when(F.col("n") < SALT_ROWS, F.col("pick")).otherwise(0)))
    rank = F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("draw", "doc_id"))
    rows = rows.withColumn("copies", F.col("epochs") + (rank <= F.col("quota")).cast("long"))
    return (
        rows.join(g, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"))
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """`docs`, each row as often as the mix takes it; the rows of an id that occurs several times share
    what the mix takes of them evenly, the first by the hash of their texts coming first."""
    taken = mix(docs, weights, most, seed).groupBy("doc_id").agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).filter("all > 0")
    doc, copies, count, copy = fresh(docs, "taken_id", "taken_copies", "taken_rows", "taken_copy")
    counts = cut(taken).toDF(doc, copies, count)
    rows = docs.join(counts, docs["doc_id"].eqNullSafe(counts[doc]))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    share = F.floor(F.col(copies) / F.col(count)) + (nth <= F.col(copies) % F.col(count)).cast("long")
    rows = rows.withColumn(copies, share).filter(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
