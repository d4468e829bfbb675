"""Edges: parsing, resolution, neighbours, hops, backlinks, and what hangs loose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import paths as p
from quillspark.functions.text import title
from quillspark.sources.store import stored

# A wiki link, or a Markdown link whose target isn't blank; either with a leading ! as an embed.
_LINK = "!?\\[\\[(?:(?!\\]\\]).)*\\]\\]|!?\\[(?!\\[)[^\\]\\n]*\\]\\((?=[^)\\n]*[^)\\s])[^)\\n]*\\)"
_TYPED = "^\\s*([a-z][a-z0-9-]*)\\s*\\[\\[((?:(?!\\]\\]).)*)\\]\\](.*)$"


def _split(rows: DataFrame) -> DataFrame:
    """target and caption of `inner` (target|alias)."""
    alias = F.trim(F.regexp_extract("inner", "^[^|]*\\|(.*)$", 1))
    return rows.withColumn("target", F.trim(F.regexp_extract("inner", "^([^|]*)", 1))).withColumn("caption", F.when(F.col("inner").contains("|"), alias))


def body_links(notes: DataFrame) -> DataFrame:
    """(src_path, pos, type, target, caption, embed, md, explanation, origin) of notes (path, body)."""
    found = notes.select(F.col("path").alias("src_path"), F.posexplode(F.regexp_extract_all("body", F.lit("(?d)" + _LINK), F.lit(0))).alias("pos", "raw"))
    found = found.withColumn("embed", F.col("raw").startswith("!")).withColumn("raw", F.regexp_replace("raw", "^!", ""))
    found = found.withColumn("md", ~F.col("raw").startswith("[["))
    wiki = _split(found.filter(~F.col("md")).withColumn("inner", F.regexp_extract("raw", "(?s)^\\[\\[(.*)\\]\\]$", 1))).drop("inner")
    text = F.trim(F.regexp_extract("raw", "^\\[([^\\]]*)\\]", 1))
    md = found.filter("md").withColumn("target", F.trim(F.regexp_extract("raw", "\\]\\(([^)]*)\\)$", 1))).withColumn("caption", F.nullif(text, F.lit("")))
    rows = wiki.unionByName(md.filter(~p.external(F.col("target")))).filter("target <> ''")
    return rows.select("src_path", "pos", F.lit("references").alias("type"), "target", "caption", "embed", "md", F.lit(None).cast("string").alias("explanation"), F.lit("inline").alias("origin"))


def relation_links(notes: DataFrame) -> DataFrame:
    """The same columns of the notes' `relations`: <verb> [[target|alias]] — explanation, or a bare link."""
    each = notes.select(F.col("path").alias("src_path"), F.posexplode("relations").alias("pos", "spec"))
    each = each.withColumn("verb", F.regexp_extract("spec", _TYPED, 1)).withColumn("inner", F.when(F.col("verb") != "", F.regexp_extract("spec", _TYPED, 2)).otherwise(F.regexp_extract("spec", "\\[\\[((?:(?!\\]\\]).)*)\\]\\]", 1)))
    tail = F.regexp_extract("spec", _TYPED, 3)
    why = F.nullif(F.trim(F.regexp_extract(tail, "^\\s*[—:]\\s*(.*?)\\s*$", 1)), F.lit(""))
    rows = _split(each).filter("target <> ''")
    return rows.select("src_path", "pos", F.when(F.col("verb") != "", F.col("verb")).otherwise("references").alias("type"), "target", "caption", F.lit(False).alias("embed"), F.lit(False).alias("md"), F.when(F.col("verb") != "", why).alias("explanation"), F.lit("frontmatter").alias("origin"))


def candidates(links: DataFrame) -> DataFrame:
    """links with candidates: the paths a target may mean, the first first. Fragments don't count;
    a Markdown target is seen from its note's folder first, then from the root; a note may lack .md."""
    bare = F.nullif(F.trim(F.regexp_replace("target", "#.*$", "")), F.lit(""))
    root = p.resolved(F.lit(""), F.col("bare"))
    bases = F.when(F.col("md"), F.array(p.resolved(F.col("src_path"), F.col("bare")), root)).otherwise(F.array(F.col("bare")))
    links = links.withColumn("bare", bare).withColumn("bases", F.filter(bases, lambda b: b.isNotNull()))
    as_note = F.flatten(F.transform("bases", lambda b: F.array(b, F.concat(b, F.lit(".md")))))
    return links.withColumn("candidates", F.when(p.kind(F.col("bare")) == "note", as_note).otherwise(F.col("bases"))).drop("bases", "bare")


def resolve(links: DataFrame, notes: DataFrame, resources: DataFrame) -> DataFrame:
    """links with dst_path and dst_resource_path: the first candidate that exists; both null dangle."""
    links = candidates(links.withColumn("link", F.struct("src_path", "origin", "pos")))
    known = notes.select("path", F.lit(True).alias("note")).union(resources.select("path", F.lit(False)))
    tries = links.select("link", F.posexplode("candidates").alias("k", "path")).join(known, "path")
    tries = tries.filter(F.col("note") == (p.kind(F.col("path")) == "note"))
    best = tries.groupBy("link").agg(F.min_by(F.struct("path", "note"), "k").alias("b"))
    rows = links.join(best, "link", "left")
    return rows.withColumn("dst_path", F.when(F.col("b.note"), F.col("b.path"))).withColumn("dst_resource_path", F.when(~F.col("b.note"), F.col("b.path"))).drop("b", "link", "candidates")


def edges(inline: DataFrame, front: DataFrame) -> DataFrame:
    """The edges of resolved links: what frontmatter says of a target and type replaces what the body
    says; occurrences count from 0 in written order, the body's first."""
    target = F.coalesce("dst_path", "dst_resource_path", "target")
    inline, front = inline.withColumn("key", target), front.withColumn("key", target)
    same = ["src_path", "key", "type"]
    kept = inline.join(front.select(*same).distinct(), same, "left_anti").withColumn("src_order", F.lit(0)).unionByName(front.withColumn("src_order", F.lit(1)))
    nth = (F.row_number().over(W.partitionBy(*same).orderBy("src_order", "pos")) - 1).cast("int")
    rows = kept.withColumn("occurrence_index", nth)
    return rows.select(p.edge_id(F.col("src_path"), F.col("key"), F.col("type"), F.col("occurrence_index")).alias("id"), "src_path", "dst_path", "dst_resource_path", F.col("target").alias("dst_path_raw"), "type", "origin", "explanation", "embed", "caption", "occurrence_index")


def neighbors(edges_: DataFrame, notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, path, title, relation, direction, label, explanation, origin, created, at): outbound by
    type and target, then inbound by type and source; a note that is linked twice is there twice."""
    out = edges_.filter("dst_path is not null").select(F.col("src_path").alias("anchor"), F.col("dst_path").alias("path"), "type", "explanation", "origin", "occurrence_index", F.lit("out").alias("direction"))
    back = edges_.filter("dst_path is not null").select(F.col("dst_path").alias("anchor"), F.col("src_path").alias("path"), "type", "explanation", "origin", "occurrence_index", F.lit("in").alias("direction"))
    rows = out.union(back).join(anchors, "anchor", "left_semi").join(notes.select("path", "created"), "path", "left")
    order = W.partitionBy("anchor").orderBy(F.desc("direction"), "type", "path", "occurrence_index")
    return rows.select("anchor", "path", title(F.col("path")).alias("title"), F.col("type").alias("relation"), "direction", p.label(F.col("type"), F.col("direction")).alias("label"), "explanation", "origin", "created", (F.row_number().over(order) - 1).alias("at"))


def dangling(edges_: DataFrame) -> DataFrame:
    return edges_.filter("dst_path is null and dst_resource_path is null").select("src_path", F.col("dst_path_raw").alias("target"), F.col("type").alias("relation"), "origin", "explanation", "occurrence_index")


def backlinks(edges_: DataFrame, notes: DataFrame) -> DataFrame:
    """(resource, path, title, relation, caption, embed, occurrence_index): notes that link a resource."""
    rows = edges_.filter("dst_resource_path is not null").join(notes.select(F.col("path").alias("src_path")), "src_path", "left_semi")
    return rows.select(F.col("dst_resource_path").alias("resource"), F.col("src_path").alias("path"), title(F.col("src_path")).alias("title"), F.col("type").alias("relation"), "caption", "embed", "occurrence_index")


def file_links(edges_: DataFrame, resources: DataFrame) -> DataFrame:
    rows = edges_.join(resources.select(F.col("path").alias("dst_resource_path"), "class"), "dst_resource_path")
    return rows.select("src_path", F.col("dst_resource_path").alias("path"), "class", F.col("type").alias("relation"), "origin", "caption", "embed", "explanation", "occurrence_index")


def reachable(edges_: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(anchor, path, hop): notes within so many edges, either way, of each of `anchors` (anchor),
    itself at 0. Only notes lead on. One join a hop; each frontier leaves out what was seen, and is
    written as a table, so that no hop's plan holds those of all before it."""
    links = edges_.filter("dst_path is not null").select("src_path", "dst_path")
    both = links.union(links.select("dst_path", "src_path")).toDF("path", "to").distinct()
    seen = anchors.select("anchor", F.col("anchor").alias("path"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        front = stored(front.join(both, "path").select("anchor", F.col("to").alias("path")).distinct().join(seen, ["anchor", "path"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(front.select("anchor", "path", "hop"))
    return seen


def orphans(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Notes that no edge leads to."""
    return notes.join(edges_.filter("dst_path is not null").select(F.col("dst_path").alias("path")), "path", "left_anti").select("path")


def scene(edges_: DataFrame, anchors: DataFrame, near: DataFrame, ghosts: int = 6) -> DataFrame:
    """(anchor, path, category, edges): what a local graph shows: the anchor, the notes one edge away
    with how many edges they share with it, and the first `ghosts` of `near` (anchor, path, rank)."""
    links = edges_.filter("dst_path is not null and src_path <> dst_path").select("src_path", "dst_path")
    both = links.union(links.select("dst_path", "src_path")).toDF("anchor", "path").join(anchors, "anchor", "left_semi")
    own = anchors.select("anchor", F.col("anchor").alias("path"), F.lit("focus").alias("category"), F.lit(0).cast("long").alias("edges"))
    tied = both.groupBy("anchor", "path").agg(F.count("*").alias("edges")).select("anchor", "path", F.lit("linked").alias("category"), "edges")
    ghost = near.join(anchors, "anchor", "left_semi").filter(F.col("rank") < ghosts).select("anchor", "path", F.lit("ghost").alias("category"), F.lit(0).cast("long").alias("edges"))
    return own.unionByName(tied).unionByName(ghost)


def tree(paths: DataFrame) -> DataFrame:
    """(path, folder, parent, rank) of files (path) and the folders they are in: folders before files, each by name."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = paths.filter(F.size(parts) > 1).select(F.explode(ups).alias("path")).distinct()
    rows = folders.withColumn("folder", F.lit(True)).union(paths.select("path").withColumn("folder", F.lit(False)))
    rows = rows.withColumn("parent", F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1))
    order = W.partitionBy("parent").orderBy(F.desc("folder"), F.lower("path"), "path")
    return rows.withColumn("rank", F.row_number().over(order) - 1)


def completions(titled: DataFrame, typed: str, most: int = 50) -> DataFrame:
    """(path, label, tier): notes (path, label) for what was typed: the label begins with it, has it, or the path has it."""
    typed = typed.lower()
    tier = F.when(F.lower("label").startswith(typed), 0).when(F.lower("label").contains(typed), 1).when(F.lower("path").contains(typed), 2)
    return titled.select("path", "label", tier.alias("tier")).filter("tier is not null").orderBy("tier", F.lower("label"), "path").limit(most)
