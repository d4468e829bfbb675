"""Whether bars that were set on one vault hold on another: its own titles as queries, words it lacks as what must not be
found, the weight of its function words, and how near its authored links lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vectors import cosine
from quillspark.operators import lexical, metrics


def title_queries(notes: DataFrame) -> DataFrame:
    """(query_id, query) of notes (path, title): each title is a query that its own note answers. Blank titles ask nothing."""
    return notes.filter(F.trim("title") != "").select(F.col("path").alias("query_id"), F.col("title").alias("query"))


def nonsense(queries: DataFrame, postings: DataFrame, seed: int = 0, words: int = 3) -> DataFrame:
    """(query_id, query): for each of `queries` as many words that follow from the seed and its id, twelve letters each;
    a word that the index has, if there is such a chance, is left out."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("k").cast("string"))
    word = F.translate(F.substring(F.sha2(name, 256), 1, 12), "0123456789", "ghijklmnop")
    each = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(words))).alias("k")).withColumn("term", word)
    each = each.join(lexical.holders(postings, each).select("term"), "term", "left_anti")
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " ").alias("query"))


def coverages(postings: DataFrame, stats: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, coverage) of queries (query_id, query): the share of the words' weight that the index has; null for a query without words."""
    own = lexical.evidence(postings, stats, lexical.query_words(queries, stem)).groupBy("query_id").agg(F.max("coverage").alias("coverage"))
    return queries.select("query_id").join(own, "query_id", "left")


def transfer(postings: DataFrame, stats: DataFrame, titles: DataFrame, strangers: DataFrame, bars: list[float], stem: bool = False) -> DataFrame:
    """(bar, cut, served, titles, strangers, lowest, highest): at each coverage bar how many title queries it cuts and how many
    strangers, which the vault has nothing on, it serves; lowest is the least coverage of a title, highest the most of a stranger.
    A bar holds where it cuts and serves none."""
    rows = coverages(postings, stats, titles, stem).withColumn("positive", F.lit(True)).unionByName(coverages(postings, stats, strangers, stem).withColumn("positive", F.lit(False)))
    own = F.coalesce("coverage", F.lit(0.0))
    ends = rows.agg(F.count_if("positive").alias("titles"), F.count_if(~F.col("positive")).alias("strangers"), F.min(F.when(F.col("positive"), own)).alias("lowest"), F.max(F.when(~F.col("positive"), own)).alias("highest"))
    return metrics.evidence_grid(rows, bars).crossJoin(F.broadcast(ends))  # one row


def function_words(postings: DataFrame, stats: DataFrame, words: list[str]) -> DataFrame:
    """(term, df, idf, share): a stated list of words that carry no subject, and their weight as a share of a word's that the vault
    lacks. Coverage reads subjects where the shares are small."""
    total = stats.agg(F.count("*").alias("total"))
    asked = stats.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "term string")
    df = lexical.holders(postings, asked, "df")
    rows = asked.join(df, "term", "left").crossJoin(F.broadcast(total)).withColumn("df", F.coalesce("df", F.lit(0)))
    idf, absent = F.log((F.col("total") + 1) / (F.col("df") + 1)), F.log(F.col("total") + 1)
    return rows.select("term", "df", idf.alias("idf"), F.when(F.col("total") > 0, idf / absent).alias("share"))


def edge_bar(linked: DataFrame, unlinked: DataFrame) -> DataFrame:
    """(linked, n, q1, q2, q3): quartiles of the cosine of the best chunk pair, of pairs of notes that an author linked and of
    pairs that nobody did (both: d2). A bar for showing a pair as near lies where the two part."""
    rows = linked.select(F.lit(True).alias("linked"), cosine(F.col("d2")).alias("cos")).unionByName(unlinked.select(F.lit(False).alias("linked"), cosine(F.col("d2")).alias("cos")))
    counts = rows.groupBy("linked").agg(F.count("*").alias("n"))
    return metrics.quartiles(rows, "cos", ["linked"]).join(counts, "linked").select("linked", "n", "q1", "q2", "q3")


def self_ranks(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, rank): where each title's own note stands among its hits (query_id, path, rank from 0), null where it isn't."""
    own = hits.filter(F.col("query_id") == F.col("path")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return titles.select("query_id").join(own, "query_id", "left")


def best_unlinked(scored: DataFrame) -> DataFrame:
    """(a, b, d2): of a scored population (anchor, path, d2) each two notes once."""
    pair = scored.select(F.least("anchor", "path").alias("a"), F.greatest("anchor", "path").alias("b"), "d2")
    return pair.groupBy("a", "b").agg(F.min("d2").alias("d2"))
