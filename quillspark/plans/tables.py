"""The engine's tables made from the driver's tables, for its registered queries, and the same in SQL.

documents are notes (source/doc_id.md), their lines are chunks, embeddings with the number of a
document are its vector (vec_id = doc_id, place 0) or, in the discovery queries, five to a note;
benchmark texts are queries, embeddings number 0, 7, 14 ... the query vectors of those; edges follow
from a rule, and pages' hrefs and foreign keys are links as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.concat(F.col("doc_id"), F.lit(".md"))).alias("path"), "doc_id", F.col("lang").alias("type"), F.lit(None).cast("string").alias("created"), F.col("text").alias("body"), F.sha2("text", 256).alias("body_hash"))


NOTES = "notes AS (SELECT source || '/' || doc_id || '.md' AS path, doc_id, lang AS type, CAST(NULL AS VARCHAR) AS created, text AS body, sha256(text) AS body_hash FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that isn't empty, numbered in order."""
    rows = notes(spark, sf_dir).select(F.col("path").alias("note_path"), F.expr("inline(transform(filter(split(body, '\\n'), x -> x <> ''), (x, i) -> struct(i AS seq, x AS text)))"))
    return rows.withColumn("heading_path", F.lit(None).cast("string")).withColumn("text_hash", F.sha2("text", 256))


CHUNKS = "lined AS (SELECT path AS note_path, list_filter(string_split(body, chr(10)), lambda x: x <> '') AS l FROM notes), chunks AS (SELECT note_path, CAST(i - 1 AS INTEGER) AS seq, l[i] AS text, sha256(l[i]) AS text_hash FROM (SELECT note_path, l, unnest(range(1, len(l) + 1)) AS i FROM lined))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_path, seq, vector): vector n on the first line of document n."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return notes(spark, sf_dir).select("doc_id", F.col("path").alias("note_path")).join(e, "doc_id").select("note_path", F.lit(0).alias("seq"), "vector")


VECTORS = "vectors AS (SELECT path AS note_path, 0 AS seq, embedding AS vector FROM notes JOIN embeddings ON vec_id = doc_id)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, query_vector): the benchmark's texts, item n with the vector 7 n."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 7 = 0").select((F.col("vec_id") / 7).cast("long").alias("query_id"), F.col("embedding").alias("query_vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(e, "query_id")


QUERIES = "queries AS (SELECT item_id AS query_id, text AS query, embedding AS query_vector FROM benchmark JOIN embeddings ON vec_id = 7 * item_id)"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_path, seq, vector): five successive vectors to a note."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v/"), F.floor(F.col("vec_id") / 5), F.lit(".md")).alias("note_path"), (F.col("vec_id") % 5).cast("int").alias("seq"), F.col("embedding").alias("vector"))


GROUPS = "groups AS (SELECT 'v/' || (vec_id // 5) || '.md' AS note_path, CAST(vec_id % 5 AS INTEGER) AS seq, embedding AS vector FROM embeddings)"


def group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each group of vectors is linked with the next and with the one at twice its number."""
    g = groups(spark, sf_dir).select("note_path").distinct().select(F.regexp_extract("note_path", "(\\d+)", 1).cast("long").alias("n"))
    to = g.select("n", F.explode(F.array(F.col("n") + 1, 2 * F.col("n"))).alias("m"))
    name = lambda c: F.concat(F.lit("v/"), c, F.lit(".md"))
    return to.filter("n <> m").select(name(F.col("n")).alias("a"), name(F.col("m")).alias("b"))


GROUP_LINKS = "gn AS (SELECT DISTINCT vec_id // 5 AS n FROM embeddings), group_links AS (SELECT 'v/' || n || '.md' AS a, 'v/' || m || '.md' AS b FROM (SELECT n, n + 1 AS m FROM gn UNION ALL SELECT n, 2 * n FROM gn) WHERE n <> m)"


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(inline, front, notes, resources): links by a rule. Note n refers to notes 7 n + 1 and, twice, 3 n
    (mod 1000); one in three supports 11 n + 3 in its frontmatter, one in six refers to 3 n there too;
    one in four shows a picture, which is there if its number is even; one in ten refers to nothing."""
    n = table(spark, sf_dir, "documents").select("doc_id")
    path = lambda c: F.concat(F.lit("n/"), F.pmod(c, F.lit(1000)))
    d = F.col("doc_id")
    row = lambda when, pos, kind, target, embed: F.when(when, F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("type"), target.alias("target"), F.lit(embed).alias("embed")))
    body = F.array(row(F.lit(True), 0, "references", path(7 * d + 1), False), row(F.lit(True), 1, "references", F.concat(path(3 * d), F.lit(".md")), False), row(F.lit(True), 2, "references", path(3 * d), False), row(d % 4 == 0, 3, "references", F.concat(F.lit("files/"), d % 50, F.lit(".png")), True), row(d % 10 == 0, 4, "references", F.concat(F.lit("missing/"), d), False))
    head = F.array(row(d % 3 == 0, 0, "supports", path(11 * d + 3), False), row(d % 6 == 0, 1, "references", path(3 * d), False))
    flat = lambda rows, origin: n.select(F.concat(F.lit("n/"), d, F.lit(".md")).alias("src_path"), F.inline(F.array_compact(rows))).select("src_path", "pos", "type", "target", F.lit(None).cast("string").alias("caption"), "embed", F.lit(False).alias("md"), F.lit(None).cast("string").alias("explanation"), F.lit(origin).alias("origin"))
    known = n.select(F.concat(F.lit("n/"), d, F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("created"))
    pictures = spark.range(0, 50, 2).select(F.concat(F.lit("files/"), "id", F.lit(".png")).alias("path"), F.lit("image").alias("class"))
    return flat(body, "inline"), flat(head, "frontmatter"), known, pictures


LINKS = """
known AS (SELECT 'n/' || doc_id || '.md' AS path FROM documents),
pictures AS (SELECT 'files/' || i || '.png' AS path, 'image' AS class FROM range(0, 50, 2) t(i)),
inline AS (
  SELECT 'n/' || doc_id || '.md' AS src_path, 0 AS pos, 'references' AS type, 'n/' || ((7 * doc_id + 1) % 1000) AS target, false AS embed FROM documents
  UNION ALL SELECT 'n/' || doc_id || '.md', 1, 'references', 'n/' || ((3 * doc_id) % 1000) || '.md', false FROM documents
  UNION ALL SELECT 'n/' || doc_id || '.md', 2, 'references', 'n/' || ((3 * doc_id) % 1000), false FROM documents
  UNION ALL SELECT 'n/' || doc_id || '.md', 3, 'references', 'files/' || (doc_id % 50) || '.png', true FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT 'n/' || doc_id || '.md', 4, 'references', 'missing/' || doc_id, false FROM documents WHERE doc_id % 10 = 0),
front AS (
  SELECT 'n/' || doc_id || '.md' AS src_path, 0 AS pos, 'supports' AS type, 'n/' || ((11 * doc_id + 3) % 1000) AS target, false AS embed FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'n/' || doc_id || '.md', 1, 'references', 'n/' || ((3 * doc_id) % 1000), false FROM documents WHERE doc_id % 6 = 0),
linked AS (SELECT *, 'inline' AS origin, 0 AS o FROM inline UNION ALL SELECT *, 'frontmatter', 1 FROM front),
reached AS (
  SELECT l.*, coalesce(a.path, b.path) AS dst_path, p.path AS dst_resource_path
  FROM linked l LEFT JOIN known a ON a.path = l.target LEFT JOIN known b ON b.path = l.target || '.md' LEFT JOIN pictures p ON p.path = l.target),
keyed AS (SELECT *, coalesce(dst_path, dst_resource_path, target) AS key FROM reached),
held AS (SELECT k.* FROM keyed k WHERE k.o = 1 OR NOT EXISTS (SELECT 1 FROM keyed f WHERE f.o = 1 AND f.src_path = k.src_path AND f.key = k.key AND f.type = k.type)),
edges AS (SELECT src_path, dst_path, dst_resource_path, target AS dst_path_raw, type, origin, embed, CAST(row_number() OVER (PARTITION BY src_path, key, type ORDER BY o, pos) - 1 AS INTEGER) AS occurrence_index FROM held)"""

#: Index tokens in SQL, as functions.text.tokens has them, with the duplicates.
TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"

POSTINGS = f"tokened AS (SELECT note_path, seq, {TOKENS.format('text')} AS t FROM chunks), stats AS (SELECT note_path, seq, len(t) AS dl FROM tokened), postings AS (SELECT term, note_path, seq, count(*) AS tf FROM (SELECT note_path, seq, unnest(t) AS term FROM tokened) GROUP BY ALL), words AS (SELECT query_id, i - 1 AS pos, t[i] AS term FROM (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT query_id, {TOKENS.format('query')} AS t FROM queries)))"

D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))"


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def ranked(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
