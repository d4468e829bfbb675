"""Registered queries of search, evidence and discovery, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import calibrate, discover, graph, lexical, search
from quillspark.plans import tables as x
from quillspark.sources.store import stored

R = lambda c, n=9: F.round(c, n).alias(c)

_DENSE = f"""pairs AS (SELECT q.query_id, v.note_path, v.seq, {x.D2.format('v.vector', 'q.query_vector')} AS d2 FROM queries q CROSS JOIN vectors v),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, note_path, seq) - 1 AS rank FROM pairs)"""
_BM25 = """total AS (SELECT count(*) AS every, avg(dl) AS avgdl FROM stats),
idf AS (SELECT term, ln((every - n + 0.5) / (n + 0.5)) AS raw FROM (SELECT term, count(*) AS n FROM postings GROUP BY term), total),
wanted AS (SELECT query_id, term, count(*) AS times FROM words GROUP BY ALL),
bm AS (SELECT query_id, p.note_path, p.seq, sum(times * CASE WHEN raw > 0 THEN raw ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM wanted JOIN postings p USING (term) JOIN idf USING (term) JOIN stats s ON s.note_path = p.note_path AND s.seq = p.seq, total GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, note_path, seq) - 1 AS rank FROM bm)"""
_EVIDENCE = """once AS (SELECT query_id, term, min(pos) AS pos FROM words GROUP BY ALL),
known AS (SELECT o.*, coalesce(d.df, 0) AS df, c.n AS chunk_total FROM once o LEFT JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) d USING (term), (SELECT count(*) AS n FROM stats) c),
weighed AS (SELECT *, ln((chunk_total + 1) / (df + 1)) AS idf FROM known),
evidence AS (SELECT *, sum(idf) OVER (PARTITION BY query_id) AS whole, sum(CASE WHEN df >= 1 THEN idf ELSE 0.0 END) OVER (PARTITION BY query_id) AS there FROM weighed)"""
_HYBRID = f"""near AS (SELECT * FROM dense WHERE rank < 150), wordy AS (SELECT * FROM sparse WHERE rank < 150),
paired AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.note_path, b.note_path) AS note_path, coalesce(a.seq, b.seq) AS seq, a.rank AS bm25_rank, b.rank AS vector_rank, 1 - b.d2 / 2 AS cos
  FROM wordy a FULL JOIN near b ON a.query_id = b.query_id AND a.note_path = b.note_path AND a.seq = b.seq),
scored AS (SELECT *, coalesce(1.0::DOUBLE / (60 + bm25_rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank + 1), 0) AS score, max(cos) OVER (PARTITION BY query_id) AS best_cos FROM paired),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, coalesce(vector_rank, 2147483647), note_path, seq) - 1 AS rank FROM scored) WHERE rank < 150)"""
_BASE = (x.NOTES, x.CHUNKS, x.VECTORS, x.QUERIES)
_ALL = (*_BASE, x.POSTINGS, _DENSE, _BM25)
_DISCOVER = f"""cells AS (SELECT note_path, i AS d, avg(CAST(vector[i] AS DOUBLE)) AS m FROM (SELECT note_path, vector, unnest(range(1, 65)) AS i FROM groups) GROUP BY ALL),
means AS (SELECT note_path, list(m ORDER BY d) AS c FROM cells GROUP BY note_path),
middle AS (SELECT note_path, list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda w: w * w)))) AS centroid FROM means)"""


_indexes: dict[tuple[str, str, bool], tuple] = {}


def _index(spark, sf_dir, stem=False):
    """The index is a table before it is asked, as in a vault: one for each folder of data and session. A chunk's postings are one
    row, written where the chunk was read: what asks reads all of them and keeps its own, so no posting is shuffled."""
    key = (spark.sparkContext.applicationId, sf_dir, stem)
    if key not in _indexes:
        rows = stored(lexical.gathered(x.chunks(spark, sf_dir), stem, packed=True))
        _indexes[key] = rows, rows.select("note_path", "seq", "dl")
    return _indexes[key]


def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built anew: how often each term occurs, and in how many chunks."""
    postings = lexical.opened(stored(lexical.gathered(x.chunks(spark, sf_dir), packed=True)))
    return postings.groupBy("term").agg(F.sum("tf").cast("long").alias("times"), F.count("*").alias("df"), F.sum("dl").cast("long").alias("lengths"))


lexical_index_sql = x.sql(*_BASE, x.POSTINGS, select="SELECT term, CAST(sum(tf) AS BIGINT) AS times, count(*) AS df, CAST(sum(dl) AS BIGINT) AS lengths FROM postings JOIN stats USING (note_path, seq) GROUP BY term")


def _hybrid(spark, sf_dir, limit=10):
    postings, stats = _index(spark, sf_dir)
    return search.hybrid(postings, stats, x.vectors(spark, sf_dir), x.queries(spark, sf_dir), search.note_pool(limit))


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.nearest(x.vectors(spark, sf_dir), x.queries(spark, sf_dir), 10)
    return near.select("query_id", "note_path", "seq", R("d2"), "rank")


vector_search_sql = x.sql(*_BASE, _DENSE, select="SELECT query_id, note_path, seq, round(d2, 9) AS d2, rank FROM dense WHERE rank < 10")


def vector_search_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector, all components the same."""
    e = x.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("note_path"), F.lit(0).alias("seq"), F.col("embedding").alias("vector"))
    return search.nearest_to(e, [0.125] * 64, 20).select("note_path", R("d2"))


vector_search_one_sql = f"SELECT CAST(vec_id AS VARCHAR) AS note_path, round(d2, 9) AS d2 FROM (SELECT vec_id, {x.D2.format('embedding', 'list_transform(range(64), lambda i: 0.125)')} AS d2 FROM embeddings) ORDER BY d2, note_path LIMIT 20"


def vector_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector_view(x.vectors(spark, sf_dir), x.queries(spark, sf_dir), 10)
    # negated after rounding, which would turn the score of an equal vector, -0.0, into 0.0
    return found.withColumn("score", -F.round(-F.col("score"), 9))


vector_only_search_sql = x.sql(*_BASE, _DENSE, select="SELECT query_id, note_path AS path, regexp_replace(regexp_extract(note_path, '[^/]*$'), '\\.md$', '') AS title, round(-sqrt(d2), 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, note_path ORDER BY rank) AS own FROM dense WHERE rank < 30) WHERE own = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, stats = _index(spark, sf_dir)
    found = lexical.best(postings, stats, lexical.query_words(x.queries(spark, sf_dir)), 10)
    return found.select("query_id", "note_path", "seq", R("score", 7), "rank")


keyword_search_sql = x.sql(*_ALL, select="SELECT query_id, note_path, seq, round(score, 7) AS score, rank FROM sparse WHERE rank < 10")


def bounded_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search that scores the blocks of chunks alone that can reach a query's last place."""
    postings, stats = _index(spark, sf_dir)
    found = lexical.best(postings, stats, lexical.query_words(x.queries(spark, sf_dir)), 10, bounded=True)
    return found.select("query_id", "note_path", "seq", R("score", 7), "rank")


bounded_keyword_search_sql = keyword_search_sql


def keyword_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over stems, as a vault has it by default; SQL has no stemmer, so a test holds it against brute force."""
    postings, stats = _index(spark, sf_dir, True)
    found = lexical.best(postings, stats, lexical.query_words(x.queries(spark, sf_dir), True), 10)
    return found.select("query_id", "note_path", "seq", R("score", 7), "rank")


def keyword_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, stats = _index(spark, sf_dir)
    found = search.hybrid(postings, stats, None, x.queries(spark, sf_dir), 30)
    return found.select("query_id", "note_path", "seq", R("score", 12), "bm25_rank", "cos", "best_cos", "rank")


keyword_only_search_sql = x.sql(*_ALL, select="SELECT query_id, note_path, seq, round(1.0::DOUBLE / (61 + rank), 12) AS score, rank AS bm25_rank, CAST(NULL AS DOUBLE) AS cos, CAST(NULL AS DOUBLE) AS best_cos, rank FROM sparse WHERE rank < 30")


def lexical_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, stats = _index(spark, sf_dir)
    found = lexical.evidence(postings, stats, lexical.query_words(x.queries(spark, sf_dir)))
    return found.select("query_id", "pos", "term", "df", R("idf"), R("coverage"), "chunk_total")


lexical_evidence_sql = x.sql(*_BASE, x.POSTINGS, _EVIDENCE, select="SELECT query_id, pos, term, df, round(idf, 9) AS idf, round(CASE WHEN whole > 2.220446049250313e-16 THEN there / whole END, 9) AS coverage, chunk_total FROM evidence")


def query_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, stats = _index(spark, sf_dir)
    q = x.queries(spark, sf_dir)
    words = lexical.evidence(postings, stats, lexical.query_words(q)).groupBy("query_id").agg(F.first("coverage").alias("coverage"))
    best = search.nearest(x.vectors(spark, sf_dir), q, 1).select("query_id", (1 - F.col("d2") / 2).alias("best_cos"))
    both = q.select("query_id").join(words, "query_id", "left").join(best, "query_id", "left")
    return both.select("query_id", R("coverage"), R("best_cos"), lexical.vouched(F.col("coverage"), F.col("best_cos")).alias("vouched"))


query_verdicts_sql = x.sql(*_BASE, x.POSTINGS, _DENSE, _EVIDENCE, select="SELECT q.query_id, round(e.c, 9) AS coverage, round(1 - d.d2 / 2, 9) AS best_cos, (coalesce(e.c, 0) >= 0.20 OR coalesce(1 - d.d2 / 2, -1) >= 0.54) AS vouched FROM queries q LEFT JOIN (SELECT query_id, any_value(CASE WHEN whole > 2.220446049250313e-16 THEN there / whole END) AS c FROM evidence GROUP BY query_id) e USING (query_id) LEFT JOIN (SELECT * FROM dense WHERE rank = 0) d USING (query_id)")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "note_path", "seq", R("score", 12), "bm25_rank", "vector_rank", R("cos"), R("best_cos"), "rank")


hybrid_search_sql = x.sql(*_ALL, _HYBRID, select="SELECT query_id, note_path, seq, round(score, 12) AS score, bm25_rank, vector_rank, round(cos, 9) AS cos, round(best_cos, 9) AS best_cos, rank FROM fused")


def search_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.note_view(_hybrid(spark, sf_dir), x.chunks(spark, sf_dir), x.queries(spark, sf_dir), 10)
    return found.select("query_id", "path", "title", R("score", 12), "rank", "bm25_rank", "vector_rank", R("cos"))


search_notes_sql = x.sql(*_ALL, _HYBRID, select="SELECT query_id, note_path AS path, regexp_replace(regexp_extract(note_path, '[^/]*$'), '\\.md$', '') AS title, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank, bm25_rank, vector_rank, round(cos, 9) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, note_path ORDER BY rank) AS own FROM fused WHERE rank < 30) WHERE own = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")


def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, stats = _index(spark, sf_dir)
    hits = search.hybrid(postings, stats, x.vectors(spark, sf_dir), x.queries(spark, sf_dir), search.passage_pool(10))
    return search.passage_view(hits, x.chunks(spark, sf_dir), 10).select("query_id", "path", R("score", 12), F.sha2("text", 256).alias("text_hash"), "rank")


search_passages_sql = x.sql(*_ALL, _HYBRID.replace("< 150", "< 60"), select="SELECT query_id, f.note_path AS path, round(score, 12) AS score, c.text_hash, rank FROM fused f JOIN chunks c ON c.note_path = f.note_path AND c.seq = f.seq WHERE rank < 10")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = x.chunks(spark, sf_dir).filter("seq = 0").withColumn("terms", F.array(F.lit("for"), F.lit("de"), F.lit("x")))
    return rows.select("note_path", t.flat(F.col("text")).alias("flat"), t.head_snippet(F.col("text"), 60).alias("head"), t.snippet(F.col("text"), F.col("terms"), 60).alias("snippet"))


_S = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
snippets_sql = x.sql(x.NOTES, x.CHUNKS, select=f"""SELECT note_path, f AS flat, CASE WHEN length(f) > 60 THEN rtrim(f[1:60]) || '…' ELSE f END AS head,
CASE WHEN coalesce(p, 0) <= 24 THEN CASE WHEN length(f) > 60 THEN rtrim(f[1:60]) || '…' ELSE f END
ELSE '…' || ltrim(CASE WHEN length(f) > p + 36 THEN rtrim(f[p - 23:p + 36]) || '…' ELSE f[p - 23:p + 36] END) END AS snippet
FROM (SELECT note_path, f, least(nullif(instr(lower(f), 'for'), 0), nullif(instr(lower(f), 'de'), 0)) - 1 AS p FROM (SELECT note_path, {_S} AS f FROM chunks WHERE seq = 0))""")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.centroids(x.groups(spark, sf_dir)).select("note_path", F.posexplode("centroid").alias("d", "v")).select("note_path", "d", R("v"))


centroids_sql = x.sql(x.GROUPS, _DISCOVER, select="SELECT note_path, i - 1 AS d, round(centroid[i], 9) AS v FROM (SELECT note_path, centroid, unnest(range(1, 65)) AS i FROM middle)")


def similar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten near notes of every note."""
    g = x.groups(spark, sf_dir)
    found = discover.similar(g, stored(discover.centroids(g)), x.group_links(spark, sf_dir), g.select(F.col("note_path").alias("anchor")).distinct(), 10)
    return found.select("anchor", "path", "seq", R("d2"), R("z", 6), "band", "rank")


_SCORED = (x.GROUPS, x.GROUP_LINKS, _DISCOVER, f"""anchors AS (SELECT DISTINCT note_path AS anchor FROM groups),
tied AS (SELECT a, b FROM group_links UNION SELECT b, a FROM group_links UNION SELECT anchor, anchor FROM anchors),
coarse AS (SELECT anchor, m.note_path, {x.D2.format('m.centroid', 'o.centroid')} AS c2 FROM anchors JOIN middle o ON o.note_path = anchor CROSS JOIN middle m WHERE NOT EXISTS (SELECT 1 FROM tied t WHERE t.a = anchor AND t.b = m.note_path)),
short AS (SELECT anchor, note_path FROM coarse QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY c2, note_path) <= 200),
exact AS (SELECT s.anchor, s.note_path AS path, g.seq, {x.D2.format('g.vector', 'o.vector')} AS d2 FROM short s JOIN groups g ON g.note_path = s.note_path JOIN groups o ON o.note_path = s.anchor),
best AS (SELECT anchor, path, min(d2) AS d2, arg_min(seq, d2 * 1e6 + seq * 1e-9) AS seq FROM exact GROUP BY ALL),
graded AS (SELECT *, CASE WHEN count(*) OVER w >= 12 AND stddev_samp(d2) OVER w > 0 THEN (avg(d2) OVER w - d2) / stddev_samp(d2) OVER w END AS z FROM best WINDOW w AS (PARTITION BY anchor))""")
similar_notes_sql = x.sql(*_SCORED, select="SELECT anchor, path, seq, round(d2, 9) AS d2, round(z, 6) AS z, CASE WHEN z >= 2.52 THEN 'strong' WHEN z >= 1.96 THEN 'clear' WHEN z IS NOT NULL THEN 'near' END AS band, row_number() OVER (PARTITION BY anchor ORDER BY d2, path) - 1 AS rank FROM graded QUALIFY rank < 10")


def score_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole population behind each note's near notes, dumped as a table, and its z worked out again from that."""
    g = x.groups(spark, sf_dir)
    dumped = stored(discover.scored(g, stored(discover.centroids(g)), x.group_links(spark, sf_dir), g.select(F.col("note_path").alias("anchor")).distinct(), 10))
    return discover.recheck(dumped).select("anchor", "n", R("mean"), R("sd"), (F.col("largest") < 1e-9).alias("same"))


score_recheck_sql = x.sql(*_SCORED, select="SELECT anchor, count(*) AS n, round(avg(d2), 9) AS mean, round(stddev_samp(d2), 9) AS sd, CASE WHEN count(*) >= 12 AND stddev_samp(d2) > 0 THEN true END AS same FROM best GROUP BY anchor")


def local_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note with the notes it is linked with and the first six of its near ones."""
    g, links = x.groups(spark, sf_dir), x.group_links(spark, sf_dir)
    anchors = g.select(F.col("note_path").alias("anchor")).distinct()
    near = discover.similar(g, stored(discover.centroids(g)), links, anchors, 10)
    return graph.scene(links.select(F.col("a").alias("src_path"), F.col("b").alias("dst_path")), anchors, near)


local_scene_sql = x.sql(*_SCORED, "l AS (SELECT a, b FROM group_links WHERE a <> b), both_ways AS (SELECT a AS anchor, b AS path FROM l UNION ALL SELECT b, a FROM l), ghosts AS (SELECT anchor, path, row_number() OVER (PARTITION BY anchor ORDER BY d2, path) - 1 AS rank FROM graded)", select="SELECT anchor, anchor AS path, 'focus' AS category, 0 AS edges FROM anchors UNION ALL SELECT b.anchor, b.path, 'linked', count(*) FROM both_ways b JOIN anchors USING (anchor) GROUP BY ALL UNION ALL SELECT anchor, path, 'ghost', 0 FROM ghosts WHERE rank < 6")


def graph_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks nearest to each query among the notes within two links of note 0."""
    links = x.group_links(spark, sf_dir).select(F.col("a").alias("src_path"), F.col("b").alias("dst_path"))
    reach = graph.reachable(links, spark.createDataFrame([("v/0.md",)], "anchor string"), 2)
    return search.within(x.groups(spark, sf_dir), reach, x.queries(spark, sf_dir), 10).select("query_id", "note_path", "seq", R("d2"), "rank")


graph_filtered_search_sql = x.sql(x.GROUPS, x.GROUP_LINKS, x.QUERIES, f"""two AS (SELECT a, b FROM group_links UNION SELECT b, a FROM group_links),
reach AS (SELECT 'v/0.md' AS path UNION SELECT b FROM two WHERE a = 'v/0.md' UNION SELECT t.b FROM two s JOIN two t ON t.a = s.b WHERE s.a = 'v/0.md'),
pairs AS (SELECT query_id, note_path, seq, {x.D2.format('vector', 'query_vector')} AS d2 FROM queries CROSS JOIN groups WHERE note_path IN (SELECT path FROM reach))""",
    select="SELECT query_id, note_path, seq, round(d2, 9) AS d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, note_path, seq) - 1 AS rank FROM pairs QUALIFY rank < 10")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct word of each query at its first place, and the first spelling of it."""
    words = x.queries(spark, sf_dir).select("query_id", F.posexplode(t.query_terms(F.col("query"))).alias("pos", "word"))
    return words.groupBy("query_id", t.fold(F.col("word")).alias("token")).agg(F.min_by("word", "pos").alias("word"), F.min("pos").alias("pos"))


query_terms_sql = x.sql(x.QUERIES, "s AS (SELECT query_id, list_filter(regexp_split_to_array(query, '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '') AS t FROM queries), w AS (SELECT query_id, i - 1 AS pos, t[i] AS word FROM (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM s))", select="SELECT query_id, lower(strip_accents(word)) AS token, arg_min(word, pos) AS word, min(pos) AS pos FROM w GROUP BY 1, 2")


_BARS = [0.05, 0.1, 0.2, 0.4, 0.8]
#: Words without a subject, of four languages.
_FUNCTION_WORDS = ["the", "of", "and", "to", "in", "de", "la", "et", "les", "der", "die", "und", "ein", "el", "los", "que", "nosuchword"]


def _titles(spark, sf_dir):
    """The first six words of each document as its title, as the tables have none."""
    return calibrate.title_queries(x.notes(spark, sf_dir).select("path", F.array_join(F.slice(F.split(F.regexp_replace("body", "\\s+", " "), " "), 1, 6), " ").alias("title")))


def title_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage bars on this vault: what they cut of its titles, and what they serve of words that it lacks."""
    postings, stats = _index(spark, sf_dir)
    titles = _titles(spark, sf_dir)
    found = calibrate.transfer(postings, stats, titles, calibrate.nonsense(titles, postings, 7), _BARS)
    return found.select("bar", "cut", "served", "titles", "strangers", R("lowest"), R("highest"))


_TITLES = f"""titled AS (SELECT path AS query_id, array_to_string(string_split(regexp_replace(body, '\\s+', ' ', 'g'), ' ')[1:6], ' ') AS query FROM notes),
titles AS (SELECT * FROM titled WHERE trim(query) <> ''),
made AS (SELECT query_id, translate(substr(sha256('7:' || query_id || ':' || k), 1, 12), '0123456789', 'ghijklmnop') AS term FROM titles, (SELECT unnest([1, 2, 3]) AS k)),
asked AS (SELECT query_id, true AS positive, unnest({x.TOKENS.format('query')}) AS term FROM titles UNION ALL SELECT query_id, false, term FROM made WHERE term NOT IN (SELECT term FROM postings)),
had AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
weights AS (SELECT DISTINCT a.query_id, a.positive, a.term, coalesce(h.df, 0) AS df, ln(((SELECT count(*) FROM stats) + 1) / (coalesce(h.df, 0) + 1)) AS idf FROM asked a LEFT JOIN had h USING (term)),
covered AS (SELECT query_id, positive, CASE WHEN sum(idf) > 2.220446049250313e-16 THEN sum(CASE WHEN df >= 1 THEN idf ELSE 0 END) / sum(idf) END AS coverage FROM weights GROUP BY ALL),
every AS (SELECT t.query_id, true AS positive, coalesce(c.coverage, 0) AS coverage FROM titles t LEFT JOIN covered c ON c.query_id = t.query_id AND c.positive UNION ALL SELECT query_id, false, coalesce(coverage, 0) FROM covered WHERE NOT positive)"""
title_transfer_sql = x.sql(x.NOTES, x.CHUNKS, x.VECTORS, x.QUERIES, x.POSTINGS, _TITLES, f"bars AS (SELECT unnest({_BARS}::DOUBLE[]) AS bar)", select="SELECT bar, count(*) FILTER (positive AND coverage < bar) AS cut, count(*) FILTER (NOT positive AND coverage >= bar) AS served, count(*) FILTER (positive) AS titles, count(*) FILTER (NOT positive) AS strangers, round(min(coverage) FILTER (positive), 9) AS lowest, round(max(coverage) FILTER (NOT positive), 9) AS highest FROM every, bars GROUP BY bar")


def function_word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, stats = _index(spark, sf_dir)
    return calibrate.function_words(postings, stats, _FUNCTION_WORDS).select("term", "df", R("idf"), R("share"))


function_word_weights_sql = x.sql(x.NOTES, x.CHUNKS, x.VECTORS, x.QUERIES, x.POSTINGS, f"w AS (SELECT unnest({_FUNCTION_WORDS}) AS term), n AS (SELECT count(*) AS n FROM stats), d AS (SELECT term, count(*) AS df FROM postings GROUP BY term), e AS (SELECT w.term, coalesce(df, 0) AS df, n, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM n, w LEFT JOIN d USING (term))", select="SELECT term, df, round(idf, 9) AS idf, round(idf / ln(n + 1), 9) AS share FROM e")


def edge_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near linked notes are against all that were compared and aren't linked."""
    g, links = x.groups(spark, sf_dir), x.group_links(spark, sf_dir)
    names = g.select(F.col("note_path").alias("anchor")).distinct()
    scored = stored(discover.scored(g, stored(discover.centroids(g)), links, names, 10))
    tied = links.select(F.least("a", "b").alias("anchor"), F.greatest("a", "b").alias("note_path")).distinct()
    linked = stored(discover.pair_distances(g, tied))
    found = calibrate.edge_bar(linked, stored(calibrate.best_unlinked(scored)))
    return found.select("linked", "n", *[R(c, 7) for c in ("q1", "q2", "q3")])


edge_bar_sql = x.sql(*_SCORED, f"""ties AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM group_links),
near_ties AS (SELECT t.a, t.b, min({x.D2.format('g.vector', 'h.vector')}) AS d2 FROM ties t JOIN groups g ON g.note_path = t.a JOIN groups h ON h.note_path = t.b GROUP BY ALL),
pairs AS (SELECT true AS linked, 1 - d2 / 2 AS cos FROM near_ties UNION ALL SELECT false, 1 - min(d2) / 2 FROM best GROUP BY least(anchor, path), greatest(anchor, path)),
placed AS (SELECT linked, cos, row_number() OVER (PARTITION BY linked ORDER BY cos) - 1 AS k, count(*) OVER (PARTITION BY linked) AS n FROM pairs)""",
    select="SELECT linked, count(*) AS n, " + ", ".join(f"round(max(CASE WHEN k = floor((n - 1) * {q} + 0.5) THEN cos END), 7) AS {name}" for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))) + " FROM placed GROUP BY linked")
