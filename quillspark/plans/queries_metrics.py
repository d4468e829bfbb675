"""Registered queries of ranking quality and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vectors import squared_l2
from quillspark.operators import discover, metrics, search
from quillspark.plans import queries_search
from quillspark.plans import tables as x
from quillspark.sources.store import stored

_RANKED = f"""pairs AS (SELECT q.query_id, v.note_path AS path, {x.D2.format('v.vector', 'q.query_vector')} AS d2 FROM queries q CROSS JOIN vectors v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, path) - 1 AS rank FROM pairs),
relevant AS (SELECT query_id, path FROM pairs WHERE regexp_extract(path, '([0-9]+)\\.md', 1)::BIGINT % 40 = query_id % 40),
firsts AS (SELECT q.query_id, f.rank FROM (SELECT DISTINCT query_id FROM relevant) q LEFT JOIN (SELECT query_id, min(rank) + 1 AS rank FROM ranked JOIN relevant USING (query_id, path) WHERE rank < 20 GROUP BY 1) f USING (query_id))"""
_TABLES = (x.NOTES, x.VECTORS, x.QUERIES, _RANKED)
_NEAR = f"""gpairs AS (SELECT a.note_path AS anchor, b.note_path AS path, min({x.D2.format('a.vector', 'b.vector')}) AS d2 FROM groups a JOIN groups b ON a.note_path <> b.note_path GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY d2, path) - 1 AS rank FROM gpairs)"""


def _ranked(spark, sf_dir):
    near = search.nearest(x.vectors(spark, sf_dir), x.queries(spark, sf_dir), 20)
    return near.select("query_id", F.col("note_path").alias("path"), "d2", "rank")


def _relevant(spark, sf_dir):
    """Notes whose number is the query's, mod 40."""
    q = x.queries(spark, sf_dir).select("query_id", (F.col("query_id") % 40).alias("m"))
    v = x.vectors(spark, sf_dir).select(F.col("note_path").alias("path"), (F.regexp_extract("note_path", "(\\d+)\\.md", 1).cast("long") % 40).alias("m"))
    return v.join(q, "m").select("query_id", "path")


def _near(spark, sf_dir, k=None, bar=float("inf")):
    """The head of each group's other groups by their best pair: the first k, or those up to a bar."""
    return discover.nearest_notes(x.groups(spark, sf_dir), k, bar)


def first_relevant_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_ranks(_ranked(spark, sf_dir), _relevant(spark, sf_dir))


first_relevant_rank_sql = x.sql(*_TABLES, select="SELECT query_id, rank FROM firsts")


def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.quality(metrics.first_ranks(_ranked(spark, sf_dir), _relevant(spark, sf_dir)))
    return found.select("queries", *[F.round(c, 9).alias(c) for c in ("hit1", "hit3", "mrr")])


ranking_quality_sql = x.sql(*_TABLES, select="SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END), 9) AS mrr FROM firsts")


def discovery_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's mate is the next one."""
    mates = x.groups(spark, sf_dir).select("note_path").distinct().select(F.regexp_extract("note_path", "(\\d+)", 1).cast("long").alias("n"))
    mates = mates.select(F.concat(F.lit("v/"), "n", F.lit(".md")).alias("anchor"), F.concat(F.lit("v/"), F.col("n") + 1, F.lit(".md")).alias("path"))
    found = metrics.discovery(stored(_near(spark, sf_dir, 50)), mates)
    return found.withColumn("mrr", F.round("mrr", 9))


discovery_quality_sql = x.sql(x.GROUPS, _NEAR, "mates AS (SELECT DISTINCT 'v/' || (vec_id // 5) || '.md' AS anchor, 'v/' || (vec_id // 5 + 1) || '.md' AS path FROM embeddings), own AS (SELECT m.*, n.rank + 1 AS rank FROM mates m LEFT JOIN (SELECT * FROM near WHERE rank < 50) n USING (anchor, path))", select="SELECT count(DISTINCT anchor) AS anchors, count(*) AS mates, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END), 9) AS mrr, count(*) FILTER (rank IS NULL) AS suppressed, (SELECT count(*) FROM near n WHERE rank < 5 AND NOT EXISTS (SELECT 1 FROM mates m WHERE m.anchor = n.anchor AND m.path = n.path)) AS strangers FROM own")


def mutual_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mutual(stored(_near(spark, sf_dir, 10)), 10)


mutual_neighbors_sql = x.sql(x.GROUPS, _NEAR, select="SELECT a.anchor AS a, a.path AS b FROM near a JOIN near b ON a.anchor = b.path AND a.path = b.anchor WHERE a.rank < 10 AND b.rank < 10 AND a.anchor < a.path")


def linked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of chunks of each two groups that are linked, either way, once."""
    g = x.groups(spark, sf_dir)
    pair = x.group_links(spark, sf_dir).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own, other = g.select(F.col("note_path").alias("a"), F.col("vector").alias("av")), g.select(F.col("note_path").alias("b"), F.col("vector").alias("bv"))
    return pair.join(own, "a").join(other, "b").groupBy("a", "b").agg(F.round(F.min(squared_l2(F.col("av"), F.col("bv"))), 9).alias("d2"))


linked_pairs_sql = x.sql(x.GROUPS, x.GROUP_LINKS, select=f"SELECT p.a, p.b, round(min({x.D2.format('g.vector', 'h.vector')}), 9) AS d2 FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM group_links) p JOIN groups g ON g.note_path = p.a JOIN groups h ON h.note_path = p.b GROUP BY p.a, p.b")


def folded_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each ranked list whose distances stay under a bar."""
    rows = _near(spark, sf_dir, bar=1.2).withColumn("close", F.round("d2", 6) < 1.2)
    return metrics.prefix(rows, "close", ["anchor"]).select("anchor", "path", "rank")


folded_ranks_sql = x.sql(x.GROUPS, _NEAR, select="SELECT anchor, path, rank FROM (SELECT *, min(CASE WHEN round(d2, 6) < 1.2 THEN 1 ELSE 0 END) OVER (PARTITION BY anchor ORDER BY rank) AS ok FROM near) WHERE ok = 1")


def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = x.groups(spark, sf_dir)
    anchors = g.select(F.col("note_path").alias("anchor")).distinct()
    links = x.group_links(spark, sf_dir)
    found = discover.similar(g, stored(discover.centroids(g)), links, anchors, 10)
    return metrics.histogram(found, "band")


band_histogram_sql = queries_search.similar_notes_sql.replace(" % 10 = 0),", " >= 0),").replace("SELECT anchor, path, seq,", "SELECT band, count(*) AS n FROM (SELECT anchor, path, seq,", 1) + ") GROUP BY band"


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.table(spark, sf_dir, "labels").join(x.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n")), "doc_id")
    return metrics.spread(rows, "n", ["quality", "toxic"]).withColumnRenamed("n", "docs")


label_stats_sql = "SELECT quality, toxic, count(*) AS docs, min(n_chars)::DOUBLE AS low, quantile_cont(n_chars::DOUBLE, 0.5) AS median, max(n_chars)::DOUBLE AS high FROM labels JOIN documents USING (doc_id) GROUP BY ALL"


def label_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.table(spark, sf_dir, "labels").join(x.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.quartiles(rows, "n_chars", ["quality"])


label_quartiles_sql = "WITH r AS (SELECT quality, n_chars, row_number() OVER (PARTITION BY quality ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels JOIN documents USING (doc_id)) SELECT quality, max(n_chars) FILTER (k = floor((n - 1) * 0.25::DOUBLE + 0.5)) AS q1, max(n_chars) FILTER (k = floor((n - 1) * 0.5::DOUBLE + 0.5)) AS q2, max(n_chars) FILTER (k = floor((n - 1) * 0.75::DOUBLE + 0.5)) AS q3 FROM r GROUP BY quality"


def admissible_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("v"), (F.col("o_orderstatus") == "F").alias("keep"))
    return metrics.window(rows, "v", "keep")


admissible_window_sql = "SELECT max(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice::DOUBLE END) AS cut_max, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DOUBLE END) AS keep_min, coalesce(max(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice::DOUBLE END) < min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DOUBLE END), true) AS admissible FROM orders"


def evidence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars on made-up coverages: each order's share of a hundred, urgent ones being the positives."""
    rows = x.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100 / 100).alias("coverage"), (F.col("o_orderpriority") == "1-URGENT").alias("positive"))
    return metrics.evidence_grid(rows, [i / 20 for i in range(1, 11)])


evidence_grid_sql = "SELECT bar, count(*) FILTER (o_orderpriority = '1-URGENT' AND (o_orderkey % 100) / 100 < bar) AS cut, count(*) FILTER (o_orderpriority <> '1-URGENT' AND (o_orderkey % 100) / 100 >= bar) AS served FROM orders CROSS JOIN (SELECT i::DOUBLE / 20 AS bar FROM range(1, 11) t(i)) GROUP BY bar"


def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes in each query's first ten when every second note counts as ten ranks lower."""
    before = _ranked(spark, sf_dir)
    lower = F.col("rank") + F.when(F.regexp_extract("path", "(\\d+)\\.md", 1).cast("long") % 2 == 0, 10).otherwise(0)
    after = x.ranked(before.select("query_id", "path", lower.alias("at")), ["query_id"], ["at", "path"])
    return metrics.change(before.filter("rank < 10"), after.filter("rank < 10"))


rank_changes_sql = x.sql(*_TABLES, "b AS (SELECT query_id, path, rank FROM ranked WHERE rank < 20), a AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY rank + CASE WHEN regexp_extract(path, '([0-9]+)\\.md', 1)::BIGINT % 2 = 0 THEN 10 ELSE 0 END, path) - 1 AS rank FROM b), j AS (SELECT coalesce(b.query_id, a.query_id) AS query_id, b.rank AS r0, a.rank AS r1 FROM (SELECT * FROM b WHERE rank < 10) b FULL JOIN (SELECT * FROM a WHERE rank < 10) a ON a.query_id = b.query_id AND a.path = b.path)", select="SELECT query_id, count(*) FILTER (r0 IS NOT NULL AND r1 IS NOT NULL) AS kept, count(*) FILTER (r0 IS NULL) AS entered, count(*) FILTER (r1 IS NULL) AS gone, count(*) FILTER (r0 <> r1) AS moved FROM j GROUP BY query_id")


def embed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.progress(x.chunks(spark, sf_dir))


embed_progress_sql = x.sql(x.NOTES, x.CHUNKS, "o AS (SELECT note_path, count(*) AS chunks FROM chunks GROUP BY 1)", select="SELECT note_path, chunks, count(*) OVER (ORDER BY note_path) AS notes_done, sum(chunks) OVER (ORDER BY note_path)::BIGINT AS chunks_done FROM o")


def embed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier table as a ledger of runs."""
    rows = x.table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), F.col("s_nationkey") % 3, F.when(F.col("s_suppkey") % 2 == 0, "@gpu").otherwise("")).alias("model"), F.col("s_suppkey").cast("long").alias("chunks"), (F.col("s_suppkey") % 7).cast("long").alias("seconds"))
    return metrics.costs(rows)


embed_costs_sql = "SELECT 'm' || (s_nationkey % 3) AS model, count(*) AS runs, sum(s_suppkey)::BIGINT AS chunks, sum(s_suppkey % 7)::BIGINT AS seconds FROM supplier GROUP BY 1"


def model_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest threshold at most each value."""
    tiers = spark.createDataFrame([(0, "small"), (3000, "medium"), (7000, "large")], "least long, tier string")
    rows = x.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"))
    found = rows.join(F.broadcast(tiers), F.col("least") <= F.col("v"), "left").groupBy("c_custkey").agg(F.max_by("tier", "least").alias("tier"))
    return found


model_tier_sql = "SELECT c_custkey, CASE WHEN c_acctbal >= 7000 THEN 'large' WHEN c_acctbal >= 3000 THEN 'medium' WHEN c_acctbal >= 0 THEN 'small' END AS tier FROM customer"


def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite as many of three passages as their conversation's turn number says."""
    rows = x.table(spark, sf_dir, "conversations").select(F.transform(F.sequence(F.lit(1), (F.col("turn") % 5).cast("int") + 1), lambda n: n).alias("markers"), F.lit(3).alias("passages"))
    found = metrics.groundedness(rows)
    return found.select("answers", F.round("cited", 9).alias("cited"), F.round("resolved", 9).alias("resolved"))


groundedness_sql = "SELECT count(*) AS answers, 1.0::DOUBLE AS cited, round(sum(least(3, turn % 5 + 1))::DOUBLE / sum(turn % 5 + 1), 9) AS resolved FROM conversations"
