"""Changes to a vault as changes to its table of notes' files (path, content).

Moving, deleting or adding is a filter or union of that table, and a move rewrites the links of the
notes that have an edge to what moved, and of no others. Writing the table back is the caller's
`write`; the index follows by the next projection, as with any change from outside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import paths as p
from quillspark.functions.frontmatter import span


class Refused(ValueError):
    """A change that the vault can't take: a bad place, something there already, or another revision."""


def checked(path: str) -> str:
    """`path` as a place in a vault, or Refused."""
    parts = path.split("/")
    if not path or path.startswith("/") or ".." in parts or "" in parts or any(x.startswith(".") for x in parts):
        raise Refused(f"not a place in the vault: {path!r}")
    return path


def _holds(files: DataFrame, path: str) -> bool:
    return not files.filter(F.col("path") == path).isEmpty()


def add(files: DataFrame, path: str, text: str | bytes) -> DataFrame:
    """`files` and a new note or resource; Refused where there is one."""
    if _holds(files, checked(path)):
        raise Refused(f"there already: {path}")
    return files.unionByName(files.sparkSession.createDataFrame([(path, text.encode() if isinstance(text, str) else text)], "path string, content binary"), allowMissingColumns=True)


def template(title: str, today: str, kind: str | None = None) -> str:
    """A new note's text."""
    quoted = title.replace("\\", "\\\\").replace('"', '\\"')
    return "---\n" + (f"type: {kind}\n" if kind else "") + f'title: "{quoted}"\ncreated: {today}\nupdated: {today}\n---\n\n'


def revision(content: Column) -> Column:
    return F.sha2(content, 256)


def write_body(files: DataFrame, path: str, body: str, expected: str | None = None) -> DataFrame:
    """`files` with a note's body replaced and its frontmatter as it was; Refused where the note isn't
    at the expected revision any more."""
    row = files.filter(F.col("path") == path).select(revision(F.col("content")).alias("r")).first()
    if row is None or (expected is not None and row["r"] != expected):
        raise Refused(f"not there at that revision: {path}")
    text = F.concat(span(F.col("content").cast("string")), F.lit(body)).cast("binary")
    return files.withColumn("content", F.when(F.col("path") == path, text).otherwise(F.col("content")))


def write_frontmatter(files: DataFrame, path: str, block: str, expected: str | None = None) -> DataFrame:
    """`files` with a note's frontmatter replaced; a block with a --- line would end early and is Refused."""
    if any(line.rstrip() == "---" for line in block.splitlines()):
        raise Refused("a --- line in the frontmatter")
    row = files.filter(F.col("path") == path).select(revision(F.col("content")).alias("r")).first()
    if row is None or (expected is not None and row["r"] != expected):
        raise Refused(f"not there at that revision: {path}")
    text = F.col("content").cast("string")
    new = F.concat(F.lit(f"---\n{block.rstrip()}\n---\n"), F.substring(text, F.length(span(text)) + 1, F.length(text)))
    return files.withColumn("content", F.when(F.col("path") == path, new.cast("binary")).otherwise(F.col("content")))


def relate(files: DataFrame, src: str, verb: str, dst: str, explanation: str | None = None, relations_key: str = "relations") -> DataFrame:
    """`files` with a relation in a note's frontmatter; one that is there already changes nothing."""
    if verb not in p.INVERSE:
        raise Refused(f"no relation: {verb}")
    target = dst.removesuffix(".md")
    quoted = lambda x: x.replace("\\", "\\\\").replace('"', '\\"')
    entry = '  - "' + quoted(f"{verb} [[{target}]]" + (f" — {explanation}" if explanation else "")) + '"\n'
    text = F.col("content").cast("string")
    block = span(text)
    there = f"(\\Q{target}\\E|\\Q{quoted(target)}\\E)"  # plain, or as quotes have it
    has = block.rlike(f"(?m)^\\s*-\\s*\"?{verb} \\[\\[{there}(\\.md)?(\\|[^\\]]*)?\\]\\]")
    line = f"(?m)^{relations_key}:[ \\t]*$\\n"
    rest = F.substring(text, F.length(block) + 1, F.length(text))
    into = F.when(block.rlike(line), F.concat(F.regexp_extract(block, f"(?s)^(.*?{line})", 1), F.lit(entry), F.regexp_replace(block, f"(?s)^.*?{line}", ""))).when(block == "", F.lit(f"---\n{relations_key}:\n{entry}---\n")).otherwise(F.concat(F.regexp_replace(block, "---[ \\t]*\\r?\\n?$", ""), F.lit(f"{relations_key}:\n{entry}---\n")))
    new = F.when((F.col("path") == src) & ~has, F.concat(into, rest).cast("binary")).otherwise(F.col("content"))
    return files.withColumn("content", new)


def _relative(src: Column, dst: Column) -> Column:
    """`dst` as seen from the folder of `src`."""
    a = F.filter(F.split(F.regexp_extract(src, "^(?:(.*)/)?[^/]*$", 1), "/"), lambda x: x != "")
    b = F.split(dst, "/")
    most = F.least(F.size(a), F.size(b) - 1)
    shared = F.size(F.filter(F.sequence(F.lit(0), most), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n))) - 1
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b))), "/")


def _relinked(files: DataFrame, edges: DataFrame, place: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(`files` by the places that `place` gives them, the paths of rewritten notes).

    Links keep the form they were written in: with or without .md, from the root or from their note's
    folder, with their fragment. A moved note's own relative links are seen from its new folder.
    """
    dst, raw = F.coalesce("dst_path", "dst_resource_path"), F.trim(F.regexp_replace("dst_path_raw", "#.*$", ""))
    src = F.col("src_path")
    ties = edges.filter(dst.isNotNull()).select(src, dst.alias("dst"), raw.alias("raw")).filter((raw != "") & ((place(F.col("dst")) != F.col("dst")) | (place(src) != src))).distinct()
    bare = ~F.col("raw").endswith(".md") & F.col("dst").endswith(".md")
    seen = p.resolved(src, F.col("raw"))
    near = (seen == F.col("dst")) | (F.concat(seen, F.lit(".md")) == F.col("dst"))
    short = lambda c: F.when(bare, F.regexp_replace(c, "\\.md$", "")).otherwise(c)
    safe = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    own, goal = place(src), place(F.col("dst"))
    ties = ties.select(F.col("src_path").alias("path"), F.struct("raw", safe(short(goal)).alias("wiki"), safe(short(F.when(near, _relative(own, goal)).otherwise(goal))).alias("md")).alias("tie"))
    ties = ties.groupBy("path").agg(F.collect_list("tie").alias("_ties"))

    def one(text: Column, tie: Column) -> Column:
        what = F.concat(F.lit("\\Q"), tie["raw"], F.lit("\\E"))
        wiki = F.concat(F.lit("(\\[\\[\\s*)"), what, F.lit("(\\s*(?:[#|][^\\]]*)?\\]\\])"))
        md = F.concat(F.lit("(\\]\\(\\s*)"), what, F.lit("((?:#[^)]*)?\\s*\\))"))
        return F.regexp_replace(F.regexp_replace(text, wiki, F.concat(F.lit("$1"), tie["wiki"], F.lit("$2"))), md, F.concat(F.lit("$1"), tie["md"], F.lit("$2")))

    rows = files.join(ties, "path", "left")
    new = F.when(F.col("_ties").isNotNull(), F.aggregate("_ties", F.col("content").cast("string"), one).cast("binary")).otherwise(F.col("content"))
    rows = rows.withColumn("_new", new)
    rewritten = rows.filter(F.col("_new") != F.col("content")).select("path")
    return rows.withColumn("content", F.col("_new")).withColumn("path", place(F.col("path"))).select(*files.columns), rewritten


def move(files: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(`files` with `old` at `new`, the paths of rewritten notes). Notes with an edge to `old`, and the
    relative links of `old` itself, are rewritten in the form they were written in."""
    if not _holds(files, old):
        raise Refused(f"not there: {old}")
    if old == new or (_holds(files, checked(new)) and old.lower() != new.lower()):
        raise Refused(f"there already: {new}")
    return _relinked(files, edges, lambda c: F.when(c == old, new).otherwise(c))


def move_folder(files: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Every file under `old` at the same place under `new`, and links to any of them with it; a folder
    doesn't move into itself."""
    if p.inside(checked(new), old) or files.filter(p.under(F.col("path"), new)).isEmpty() is False:
        raise Refused(f"there already: {new}")
    return _relinked(files, edges, lambda c: F.when(p.under(c, old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))).otherwise(c))


def delete(files: DataFrame, edges: DataFrame, path: str, folder: bool = False) -> tuple[DataFrame, DataFrame]:
    """(`files` without it, the notes whose links to it now dangle, sorted)."""
    gone = lambda c: p.under(c, path) if folder else c == path
    if files.filter(gone(F.col("path"))).isEmpty():
        raise Refused(f"not there: {path}")
    target = F.coalesce("dst_path", "dst_resource_path", F.lit(""))
    dangled = edges.filter(gone(target) & ~gone(F.col("src_path"))).select(F.col("src_path").alias("path")).distinct().orderBy("path")
    return files.filter(~gone(F.col("path"))), dangled


def write(files: DataFrame, folder: str) -> None:
    """Writes a table of files as Parquet, for the next projection or an export."""
    files.write.mode("overwrite").parquet(folder)
