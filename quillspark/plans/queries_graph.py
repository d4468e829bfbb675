"""Registered queries of links, edges, paths and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import paths as p
from quillspark.functions import text as t
from quillspark.operators import graph
from quillspark.plans import tables as x


def _edges(spark, sf_dir):
    inline, front, known, pictures = x.links(spark, sf_dir)
    return graph.edges(graph.resolve(inline, known, pictures), graph.resolve(front, known, pictures)), known, pictures


def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[0].drop("explanation", "caption")


edge_resolution_sql = x.sql(x.LINKS, select="SELECT substr(sha256(src_path || chr(31) || coalesce(dst_path, dst_resource_path, dst_path_raw) || chr(31) || type || chr(31) || occurrence_index), 1, 32) AS id, * FROM edges")


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, known, _ = _edges(spark, sf_dir)
    return graph.neighbors(edges, known, known.select(F.col("path").alias("anchor"))).select("anchor", "path", "title", "relation", "direction", "label", "origin", "at")


neighbors_sql = x.sql(x.LINKS, "n AS (SELECT src_path AS anchor, dst_path AS path, type, origin, occurrence_index, 'out' AS direction FROM edges WHERE dst_path IS NOT NULL UNION ALL SELECT dst_path, src_path, type, origin, occurrence_index, 'in' FROM edges WHERE dst_path IS NOT NULL)", select="SELECT anchor, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '') AS title, type AS relation, direction, CASE WHEN direction = 'out' THEN type ELSE CASE type WHEN 'references' THEN 'referenced-by' WHEN 'supports' THEN 'supported-by' ELSE type END END AS label, origin, row_number() OVER (PARTITION BY anchor ORDER BY direction DESC, type, path, occurrence_index) - 1 AS at FROM n")


def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling(_edges(spark, sf_dir)[0]).drop("explanation")


unresolved_links_sql = x.sql(x.LINKS, select="SELECT src_path, dst_path_raw AS target, type AS relation, origin, occurrence_index FROM edges WHERE dst_path IS NULL AND dst_resource_path IS NULL")


def resource_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, known, _ = _edges(spark, sf_dir)
    return graph.backlinks(edges, known).drop("caption")


resource_backlinks_sql = x.sql(x.LINKS, select="SELECT dst_resource_path AS resource, src_path AS path, regexp_replace(regexp_extract(src_path, '[^/]*$'), '\\.md$', '') AS title, type AS relation, embed, occurrence_index FROM edges WHERE dst_resource_path IS NOT NULL AND src_path IN (SELECT path FROM known)")


def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, pictures = _edges(spark, sf_dir)
    return graph.file_links(edges, pictures).drop("caption", "explanation")


file_links_sql = x.sql(x.LINKS, select="SELECT e.src_path, p.path, p.class, e.type AS relation, e.origin, e.embed, e.occurrence_index FROM edges e JOIN pictures p ON p.path = e.dst_resource_path")


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops from three notes, one of which isn't there."""
    anchors = spark.createDataFrame([("n/0.md",), ("n/7.md",), ("n/none.md",)], "anchor string")
    return graph.reachable(_edges(spark, sf_dir)[0], anchors, 3)


reachable_sql = x.sql(x.LINKS, "two AS (SELECT src_path AS a, dst_path AS b FROM edges WHERE dst_path IS NOT NULL UNION SELECT dst_path, src_path FROM edges WHERE dst_path IS NOT NULL), h0 AS (SELECT unnest(['n/0.md', 'n/7.md', 'n/none.md']) AS anchor), r AS (SELECT anchor, anchor AS path, 0 AS hop FROM h0), h1 AS (SELECT DISTINCT anchor, b AS path, 1 AS hop FROM r JOIN two ON a = path), h2 AS (SELECT DISTINCT anchor, b AS path, 2 AS hop FROM h1 JOIN two ON a = path), h3 AS (SELECT DISTINCT anchor, b AS path, 3 AS hop FROM h2 JOIN two ON a = path)", select="SELECT anchor, path, min(hop) AS hop FROM (SELECT * FROM r UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY ALL")


def orphan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes and labels as links to them: documents without a label."""
    known = x.table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"))
    edges = x.table(spark, sf_dir, "labels").select(F.concat(F.lit("l/"), "doc_id").alias("src_path"), F.concat(F.lit("d/"), "doc_id").alias("dst_path"))
    return graph.orphans(known, edges)


orphan_notes_sql = "SELECT 'd/' || doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def inbound_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links a move of each note would rewrite, and in how many notes."""
    edges = _edges(spark, sf_dir)[0].filter("dst_path is not null")
    return edges.groupBy(F.col("dst_path").alias("path")).agg(F.count("*").alias("links"), F.countDistinct("src_path").alias("notes"))


inbound_rewrites_sql = x.sql(x.LINKS, select="SELECT dst_path AS path, count(*) AS links, count(DISTINCT src_path) AS notes FROM edges WHERE dst_path IS NOT NULL GROUP BY 1")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hrefs of the pages: which leave the site, and what kind of thing the others name."""
    rows = x.table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "target"))
    return rows.select("page_id", "pos", "target", p.external(F.col("target")).alias("external"), p.kind(F.col("target")).alias("kind"), p.resource_class(F.col("target")).alias("class"))


_EXT = "lower(regexp_extract({0}, '[^/]\\.([^./]+)$', 1))"
_CLASS = "CASE " + " ".join("WHEN {0} IN (" + ", ".join(f"'{e}'" for e in own.split()) + f") THEN '{name}'" for name, own in p.CLASSES.items()) + " ELSE 'binary' END"
page_links_sql = f"""SELECT page_id, i - 1 AS pos, l[i] AS target, regexp_matches(l[i], '^(/|#|[A-Za-z]+:)') AS external, CASE WHEN {_EXT.format('l[i]')} IN ('', 'md') THEN 'note' ELSE 'resource' END AS kind, {_CLASS.format(_EXT.format('l[i]'))} AS class
FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))"""


def resource_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with each part's type as extension, and how they are listed."""
    parts = x.table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit("."), F.element_at(F.array(*[F.lit(e) for e in ("png", "TXT", "pdf", "md", "Mp4", "htm", "zip", "")]), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("path"))
    return parts.select("path", p.kind(F.col("path")).alias("kind"), p.resource_class(F.col("path")).alias("class"), t.title(F.col("path")).alias("title"), p.hidden(F.col("path")).alias("hidden"))


resource_classes_sql = f"SELECT path, CASE WHEN {_EXT.format('path')} IN ('', 'md') THEN 'note' ELSE 'resource' END AS kind, {_CLASS.format(_EXT.format('path'))} AS class, regexp_replace(path, '(.)\\.md$', '\\1', 'i') AS title, regexp_matches(path, '(^|/)\\.') AS hidden FROM (SELECT p_partkey || '.' || ['png', 'TXT', 'pdf', 'md', 'Mp4', 'htm', 'zip', ''][p_partkey % 8 + 1] AS path FROM part)"


def list_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.notes(spark, sf_dir).select("path", t.title(F.col("path")).alias("title"), "body_hash", p.under(F.col("path"), "src1").alias("in_src1")).orderBy("path")


list_notes_sql = x.sql(x.NOTES, select="SELECT path, doc_id::VARCHAR AS title, body_hash, starts_with(path, 'src1/') AS in_src1 FROM notes ORDER BY path")


def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree(x.notes(spark, sf_dir))


tree_rows_sql = x.sql(x.NOTES, "r AS (SELECT DISTINCT regexp_extract(path, '^([^/]*)/', 1) AS path, true AS folder FROM notes UNION ALL SELECT path, false FROM notes), q AS (SELECT *, CASE WHEN folder THEN '' ELSE regexp_extract(path, '^([^/]*)/', 1) END AS parent FROM r)", select="SELECT *, row_number() OVER (PARTITION BY parent ORDER BY folder DESC, lower(path), path) - 1 AS rank FROM q")


def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.completions(x.notes(spark, sf_dir).select("path", t.title(F.col("path")).alias("label")), "12")


autocomplete_sql = x.sql(x.NOTES, select="SELECT path, label, tier FROM (SELECT path, doc_id::VARCHAR AS label, CASE WHEN starts_with(doc_id::VARCHAR, '12') THEN 0 WHEN contains(doc_id::VARCHAR, '12') THEN 1 WHEN contains(lower(path), '12') THEN 2 END AS tier FROM notes) WHERE tier IS NOT NULL ORDER BY tier, label, path LIMIT 50")


def link_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that bodies made of the documents would have: plain, with an alias, embedded, external."""
    body = F.concat(F.lit("See [[n/"), F.col("doc_id"), F.lit("|the "), "lang", F.lit("]] and ![pic](files/"), F.col("doc_id") % 7, F.lit(".png#x)\n- [web](https://e.org) [[]] [a]( b/"), "source", F.lit(" ) [[c]")).alias("body")
    rows = graph.body_links(x.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), body))
    return rows.select("src_path", "target", "caption", "embed", "md")


link_parsing_sql = "SELECT doc_id::VARCHAR AS src_path, 'n/' || doc_id AS target, 'the ' || lang AS caption, false AS embed, false AS md FROM documents UNION ALL SELECT doc_id::VARCHAR, 'files/' || (doc_id % 7) || '.png#x', 'pic', true, true FROM documents UNION ALL SELECT doc_id::VARCHAR, 'b/' || source, 'a', false, true FROM documents"


def relation_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.array(F.concat(F.lit("supports [[n/"), F.col("doc_id"), F.lit("|x]] — as it "), "lang"), F.concat(F.lit("[["), "source", F.lit("]]")), F.lit("nothing"), F.lit("b-2 [[q]] : why "), F.lit("Verb [[z]]"))
    rows = graph.relation_links(x.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), spec.alias("relations")))
    return rows.select("src_path", "pos", "type", "target", "caption", "explanation")


relation_parsing_sql = "SELECT doc_id::VARCHAR AS src_path, 0 AS pos, 'supports' AS type, 'n/' || doc_id AS target, 'x' AS caption, 'as it ' || lang AS explanation FROM documents UNION ALL SELECT doc_id::VARCHAR, 1, 'references', source, NULL, NULL FROM documents UNION ALL SELECT doc_id::VARCHAR, 3, 'b-2', 'q', NULL, 'why' FROM documents UNION ALL SELECT doc_id::VARCHAR, 4, 'references', 'z', NULL, NULL FROM documents"


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.table(spark, sf_dir, "nation").select(F.concat(F.lit("a/b/"), "n_name", F.lit(".md")).alias("base"), F.explode(F.array(*[F.lit(s) for s in ("x", "../x.md", "./y/../z", "../../../w", "/v")])).alias("target"))
    return rows.select("base", "target", p.resolved(F.col("base"), F.col("target")).alias("path"))


relative_paths_sql = "SELECT 'a/b/' || n_name || '.md' AS base, t.target, t.path FROM nation, (VALUES ('x', 'a/b/x'), ('../x.md', 'a/x.md'), ('./y/../z', 'a/b/z'), ('../../../w', NULL), ('/v', 'a/b/v')) t(target, path)"


def typed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as typed edges, two hops on: customers and the regions of their nations."""
    c = x.table(spark, sf_dir, "customer").select(F.concat(F.lit("c/"), "c_custkey").alias("src_path"), F.concat(F.lit("n/"), "c_nationkey").alias("dst_path"))
    n = x.table(spark, sf_dir, "nation").select(F.concat(F.lit("n/"), "n_nationkey").alias("src_path"), F.concat(F.lit("r/"), "n_regionkey").alias("dst_path"))
    anchors = x.table(spark, sf_dir, "region").select(F.concat(F.lit("r/"), "r_regionkey").alias("anchor"))
    return graph.reachable(c.union(n), anchors, 2).groupBy("anchor", "hop").agg(F.count("*").alias("notes"))


typed_relations_sql = "SELECT 'r/' || r_regionkey AS anchor, 0 AS hop, 1 AS notes FROM region UNION ALL SELECT 'r/' || n_regionkey, 1, count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'r/' || n_regionkey, 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey"
