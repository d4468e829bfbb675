"""Ranking quality: first relevant ranks, hit rates, MRR, discovery, bars, folds, stability, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.ordering import numbered
from quillspark.sources.store import stored


def first_ranks(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank from 1 or null): the first relevant of ranked (query_id, path, rank from 0), for
    each query of relevant (query_id, path)."""
    hit = ranked.join(relevant, ["query_id", "path"]).groupBy("query_id").agg((F.min("rank") + 1).alias("rank"))
    return relevant.select("query_id").distinct().join(hit, "query_id", "left")


def passage_ranks(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for the first text of ranked (query_id, text, rank) that holds wanted (query_id, passage), case ignored."""
    hit = ranked.join(wanted, "query_id").filter(F.lower("text").contains(F.lower("passage"))).groupBy("query_id").agg((F.min("rank") + 1).alias("rank"))
    return wanted.select("query_id").join(hit, "query_id", "left")


def quality(ranks: DataFrame, k: int = 5) -> DataFrame:
    """(queries, hit1, hit3, mrr) of first ranks; a rank beyond `k` adds nothing to mrr."""
    return ranks.agg(
        F.count("*").alias("queries"),
        F.avg(F.when(F.col("rank") <= 1, 1.0).otherwise(0.0)).alias("hit1"),
        F.avg(F.when(F.col("rank") <= 3, 1.0).otherwise(0.0)).alias("hit3"),
        F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    )


def discovery(ranked: DataFrame, mates: DataFrame, k: int = 5) -> DataFrame:
    """(anchors, mates, mrr, suppressed, strangers): how far up each mate of mates (anchor, path) comes
    in ranked (anchor, path, rank from 0), those nowhere, and the other notes among the first `k`."""
    own = mates.join(ranked.select("anchor", "path", (F.col("rank") + 1).alias("rank")), ["anchor", "path"], "left")
    seen = ranked.filter(F.col("rank") < k).join(mates.select("anchor").distinct(), "anchor", "left_semi")
    strangers = seen.join(mates, ["anchor", "path"], "left_anti").agg(F.count("*").alias("strangers"))
    out = own.agg(F.countDistinct("anchor").alias("anchors"), F.count("*").alias("mates"), F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"), F.count_if(F.col("rank").isNull()).alias("suppressed"))
    return out.crossJoin(strangers)


def spread(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, low, median, high); the median lies between the middle two."""
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("high"))


def window(values: DataFrame, value: str, keep: str) -> DataFrame:
    """(cut_max, keep_min, admissible): whether some bar keeps all that `keep` marks and cuts the rest."""
    out = values.agg(F.max(F.when(~F.col(keep), F.col(value))).alias("cut_max"), F.min(F.when(F.col(keep), F.col(value))).alias("keep_min"))
    return out.withColumn("admissible", F.coalesce(F.col("cut_max") < F.col("keep_min"), F.lit(True)))


def quartiles(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, q1, q2, q3): the values at the rounded places of a quarter, a half and three quarters.
    Places come from one sort by ranges, so that no task sees all values of a key."""
    rows = stored(numbered(values.select(F.struct(*by).alias("_key"), F.col(value).alias("_v")), ["_key"], F.asc("_v"), name="_k"))
    rows = rows.join(F.broadcast(rows.groupBy("_key").agg(F.count("*").alias("_n"))), "_key")
    at = lambda q: F.max(F.when(F.col("_k") == F.floor((F.col("_n") - 1) * q + 0.5), F.col("_v")))
    found = rows.groupBy("_key").agg(*[at(q).alias(name) for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])
    return found.select("_key.*", "q1", "q2", "q3")


def evidence_grid(verdicts: DataFrame, bars: list[float]) -> DataFrame:
    """(bar, cut, served): of verdicts (coverage, positive), the positives below each coverage bar and the
    others that reach it."""
    grid = verdicts.sparkSession.createDataFrame([(b,) for b in bars], "bar double")
    reach = F.coalesce("coverage", F.lit(0.0)) >= F.col("bar")
    return verdicts.crossJoin(F.broadcast(grid)).groupBy("bar").agg(F.count_if(F.col("positive") & ~reach).alias("cut"), F.count_if(~F.col("positive") & reach).alias("served"))


def histogram(rows: DataFrame, band: str) -> DataFrame:
    return rows.groupBy(band).agg(F.count("*").alias("n"))


def prefix(ranked: DataFrame, holds: str, by: list[str]) -> DataFrame:
    """The rows of ranked (by, rank) before the first for which `holds` isn't true."""
    so_far = F.min(F.coalesce(F.col(holds), F.lit(False)).cast("int")).over(W.partitionBy(*by).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("_so_far", so_far).filter("_so_far = 1").drop("_so_far")


def mutual(ranked: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: notes of which each is among the other's first `k` in ranked (anchor, path, rank)."""
    own = ranked.filter(F.col("rank") < k).select("anchor", "path")
    back = own.select(F.col("path").alias("anchor"), F.col("anchor").alias("path"))
    return own.join(back, ["anchor", "path"]).filter("anchor < path").select(F.col("anchor").alias("a"), F.col("path").alias("b"))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, kept, entered, gone, moved) between two ranked lists (query_id, path, rank)."""
    rows = before.select("query_id", "path", F.col("rank").alias("r0")).join(after.select("query_id", "path", F.col("rank").alias("r1")), ["query_id", "path"], "full_outer")
    both = F.col("r0").isNotNull() & F.col("r1").isNotNull()
    return rows.groupBy("query_id").agg(F.count_if(both).alias("kept"), F.count_if(F.col("r0").isNull()).alias("entered"), F.count_if(F.col("r1").isNull()).alias("gone"), F.count_if(both & (F.col("r0") != F.col("r1"))).alias("moved"))


def groundedness(answers: DataFrame) -> DataFrame:
    """(answers, cited, resolved): the shares of answers (markers array, passages) with a marker, and of
    all markers that name a passage."""
    good = F.size(F.filter("markers", lambda m: (m >= 1) & (m <= F.col("passages"))))
    return answers.agg(F.count("*").alias("answers"), F.avg(F.when(F.size("markers") > 0, 1.0).otherwise(0.0)).alias("cited"), (F.sum(good) / F.sum(F.size("markers"))).alias("resolved"))


def progress(pending: DataFrame) -> DataFrame:
    """(note_path, chunks, notes_done, chunks_done): running counts over a pending set by path, for reports."""
    own = pending.groupBy("note_path").agg(F.count("*").alias("chunks"))
    up_to = W.orderBy("note_path").rowsBetween(W.unboundedPreceding, 0)
    return own.withColumn("notes_done", F.count("*").over(up_to)).withColumn("chunks_done", F.sum("chunks").over(up_to))


def costs(ledger: DataFrame) -> DataFrame:
    """Runs, chunks and seconds of each model, whatever its device (after an @)."""
    return ledger.groupBy(F.substring_index("model", "@", 1).alias("model")).agg(F.count("*").alias("runs"), F.sum("chunks").alias("chunks"), F.sum("seconds").alias("seconds"))
