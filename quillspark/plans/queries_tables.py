"""Registered queries of projection, upkeep, chat and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import chunking, embedders, paths
from quillspark.functions import text as t
from quillspark.operators import changes
from quillspark.plans import chat, ingest
from quillspark.plans import tables as x
from quillspark.streaming import watch

_PART = "part AS (SELECT DISTINCT text_hash, text FROM chunks WHERE substr(text_hash, 1, 1) < '8')"


def _some(spark, sf_dir):
    """Half the chunks' texts, by their hash, as if they were embedded."""
    return x.chunks(spark, sf_dir).filter("substr(text_hash, 1, 1) < '8'").select("text_hash").distinct()


def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pending(x.chunks(spark, sf_dir), _some(spark, sf_dir)).select("note_path", "seq", "text_hash")


pending_chunks_sql = x.sql(x.NOTES, x.CHUNKS, _PART, select="SELECT note_path, seq, text_hash FROM chunks WHERE text_hash NOT IN (SELECT text_hash FROM part) ORDER BY note_path, seq")


def embed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.status(x.chunks(spark, sf_dir), _some(spark, sf_dir))


embed_status_sql = x.sql(x.NOTES, x.CHUNKS, _PART, "n AS (SELECT note_path, bool_and(text_hash IN (SELECT text_hash FROM part)) AS whole FROM chunks GROUP BY 1)", select="SELECT count(*) FILTER (whole) AS embedded, count(*) AS total FROM n")


def embedded_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fully_embedded(x.chunks(spark, sf_dir), _some(spark, sf_dir))


embedded_notes_sql = x.sql(x.NOTES, x.CHUNKS, _PART, select="SELECT note_path FROM chunks GROUP BY 1 HAVING bool_and(text_hash IN (SELECT text_hash FROM part))")


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors left when the notes of half the sources are gone."""
    gone = x.chunks(spark, sf_dir).filter("note_path not like 'src1%'")
    return ingest.unreferenced(_some(spark, sf_dir), gone)


orphan_vectors_sql = x.sql(x.NOTES, x.CHUNKS, _PART, select="SELECT text_hash FROM part WHERE text_hash NOT IN (SELECT text_hash FROM chunks WHERE note_path NOT LIKE 'src1%')")


def reindex_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note in five was other than it is now, and half the chunks have vectors."""
    n = x.notes(spark, sf_dir)
    old = n.select("path", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("body_hash")).alias("body_hash"))
    return ingest.plan(n, old, ingest.fully_embedded(x.chunks(spark, sf_dir), _some(spark, sf_dir)))


reindex_plan_sql = x.sql(x.NOTES, x.CHUNKS, _PART, "w AS (SELECT note_path FROM chunks GROUP BY 1 HAVING bool_and(text_hash IN (SELECT text_hash FROM part)))", select="SELECT count(*) AS would_index, count(*) FILTER (doc_id % 5 = 0 OR path NOT IN (SELECT note_path FROM w)) AS would_embed FROM notes")


def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk text once, as a model would get it."""
    return x.chunks(spark, sf_dir).select("text_hash", "text").dropDuplicates(["text_hash"]).select("text_hash", F.length("text").alias("n"))


distinct_texts_sql = x.sql(x.NOTES, x.CHUNKS, select="SELECT DISTINCT text_hash, length(text) AS n FROM chunks")


def fake_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedders.embedded(x.chunks(spark, sf_dir), embedders.FakeEmbedder(8)).select("text_hash", F.size("vector").alias("dim"))


fake_vectors_sql = x.sql(x.NOTES, x.CHUNKS, select="SELECT DISTINCT text_hash, 8 AS dim FROM chunks")


def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents, cut to size with overlap."""
    return chunking.chunks(x.notes(spark, sf_dir)).select("note_path", "seq", "char_start", "char_end", "token_count", "text_hash")


def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = x.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o/"), "l_orderkey").alias("src_path"), F.concat(F.lit("p/"), "l_partkey").alias("key"), F.col("l_linenumber").alias("n"))
    nth = (F.row_number().over(W.partitionBy("src_path", "key").orderBy("n")) - 1).cast("int")
    return li.withColumn("occurrence", nth).select(paths.edge_id(F.col("src_path"), F.col("key"), F.lit("references"), F.col("occurrence")).alias("id"))


edge_ids_sql = "SELECT substr(sha256('o/' || l_orderkey || chr(31) || 'p/' || l_partkey || chr(31) || 'references' || chr(31) || (row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) - 1)), 1, 32) AS id FROM lineitem"


def find_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.table(spark, sf_dir, "documents").select("doc_id", t.find_all(F.col("text"), F.lit("the")).alias("places"))
    return rows.select("doc_id", F.size("places").alias("n"), F.coalesce(F.array_min("places"), F.lit(-1)).alias("first"))


find_in_text_sql = "SELECT doc_id, least(1000, len(string_split(lower(text), 'the')) - 1) AS n, instr(lower(text), 'the') - 1 AS first FROM documents"


def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("x ["), F.col("turn") + 2, F.lit("] y ["), F.col("conv_id") % 4, F.lit("] z [99999999999] [1][x]"))
    return x.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(t.citations(answer, F.lit(3)).cast("array<string>"), ",").alias("markers"))


citation_markers_sql = "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter([turn + 2, conv_id % 4, 1], lambda n: n BETWEEN 1 AND 3))), ',') AS markers FROM conversations"


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.questions(x.table(spark, sf_dir, "conversations"))


conversation_questions_sql = "SELECT conv_id AS query_id, arg_max(text, turn) AS question, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id"


def conversation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.last_turns(x.table(spark, sf_dir, "conversations"), 2)


conversation_tail_sql = "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2"


def change_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events, an hour of quiet apart."""
    found = watch.bursts(x.table(spark, sf_dir, "events"), "ts", "1 hour", by=["user_id"])
    return found.select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "changes")


change_bursts_sql = "WITH e AS (SELECT user_id, epoch_us(ts) AS ts FROM events), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM e), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s) SELECT user_id, min(ts) AS started, max(ts) + 3600000000 AS ended, count(*) AS changes FROM b GROUP BY user_id, burst"


def relevant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, ".git/").otherwise("a/"), "event_type", F.when(F.col("event_id") % 5 == 0, "/.x").otherwise("/x")).alias("path"))
    return watch.relevant(rows)


relevant_changes_sql = "SELECT event_id, 'a/' || event_type || '/x' AS path FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0"


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON; nulls are left out."""
    return x.table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("z"))).alias("row"))


json_rows_sql = "SELECT n_nationkey, '{\"path\":\"' || n_name || '\"' || CASE WHEN n_nationkey % 2 = 0 THEN ',\"z\":' || n_regionkey ELSE '' END || '}' AS row FROM nation"


def note_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of some notes over the old table, and notes no longer there gone."""
    old = x.notes(spark, sf_dir).select("path", "body_hash")
    new = x.notes(spark, sf_dir).filter("doc_id % 3 = 0").select("path", F.lit("new").alias("body_hash"))
    there = x.notes(spark, sf_dir).filter("doc_id % 7 <> 0").select("path")
    return old.join(new, "path", "left_anti").unionByName(new).join(there, "path", "left_semi")


note_upsert_sql = x.sql(x.NOTES, select="SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE body_hash END AS body_hash FROM notes WHERE doc_id % 7 <> 0")


def rekeyed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder under another name, in the tables."""
    return x.notes(spark, sf_dir).select(F.when(paths.under(F.col("path"), "src1"), F.concat(F.lit("moved/src1"), F.substring("path", 5, 1 << 20))).otherwise(F.col("path")).alias("path"), "body_hash")


rekeyed_notes_sql = x.sql(x.NOTES, select="SELECT CASE WHEN starts_with(path, 'src1/') THEN 'moved/' || path ELSE path END AS path, body_hash FROM notes")


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files and as they are after a rule: one in seven is gone, of the others one in three lies in
    another folder, one in five has other text, and one in eleven has a new copy beside it."""
    d = F.col("doc_id")
    name = F.concat_ws("/", "source", F.concat(d, F.lit(".md")))
    rows = x.table(spark, sf_dir, "documents").select("doc_id", name.alias("path"), F.sha2("text", 256).alias("hash"))
    now = rows.filter(d % 7 != 0).withColumn("hash", F.when(d % 5 == 0, F.sha2(F.concat("hash", F.lit("+")), 256)).otherwise(F.col("hash")))
    moved = now.select(F.when(d % 3 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "hash")
    copies = now.filter(d % 11 == 0).select(F.concat(F.lit("copies/"), "path").alias("path"), "hash")
    return changes.between(rows.select("path", "hash"), moved.unionByName(copies))


document_changes_sql = """WITH a AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, sha256(text) AS hash FROM documents),
kept AS (SELECT doc_id, path, CASE WHEN doc_id % 5 = 0 THEN sha256(hash || '+') ELSE hash END AS hash FROM a WHERE doc_id % 7 <> 0),
b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'moved/' || path ELSE path END AS path, hash FROM kept UNION ALL SELECT 'copies/' || path, hash FROM kept WHERE doc_id % 11 = 0),
gone AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM a WHERE path NOT IN (SELECT path FROM b)),
came AS (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM a))
SELECT coalesce(c.path, g.path) AS path, CASE WHEN c.path IS NOT NULL THEN g.path END AS old_path,
  CASE WHEN c.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'created' ELSE 'renamed' END AS change, coalesce(c.hash, g.hash) AS hash
FROM gone g FULL JOIN came c ON c.hash = g.hash AND c.n = g.n
UNION ALL SELECT a.path, NULL, 'changed', b.hash FROM a JOIN b USING (path) WHERE a.hash <> b.hash"""


def embedding_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text embedded alone and among others: no difference."""
    texts = x.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "text")
    return embedders.slices_agree(texts, embedders.FakeEmbedder(16))


embedding_slices_sql = "SELECT DISTINCT sha256(text) AS text_hash, 0.0::DOUBLE AS largest FROM documents"
