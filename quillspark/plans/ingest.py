"""From files to tables: project, embed, reindex, plan. An incremental run equals a full one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import chunking, embedders, frontmatter
from quillspark.operators import discover, graph, lexical
from quillspark.sources import vault
from quillspark.sources.catalog import Catalog
from quillspark.sources.store import stored


def pending(chunks: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Chunks whose text has no vector, by path and place; each run derives them anew."""
    rows = chunks if vectors is None else chunks.join(vectors.select("text_hash"), "text_hash", "left_anti")
    return rows.orderBy("note_path", "seq")


def fully_embedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(note_path): notes with chunks, all of which have a vector."""
    rows = chunks.join(vectors.select("text_hash", F.lit(True).alias("there")).distinct(), "text_hash", "left")
    return rows.groupBy("note_path").agg(F.count("*").alias("n"), F.count("there").alias("v")).filter("n = v").select("note_path")


def status(chunks: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """(embedded, total): notes with chunks, and those fully embedded."""
    total = chunks.select("note_path").distinct().agg(F.count("*").alias("total"))
    if vectors is None:
        return total.select(F.lit(0).cast("long").alias("embedded"), "total")
    return fully_embedded(chunks, vectors).agg(F.count("*").alias("embedded")).crossJoin(total)


def unreferenced(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose text no chunk has."""
    return vectors.join(chunks.select("text_hash"), "text_hash", "left_anti")


def plan(notes: DataFrame, old: DataFrame | None, vectors_of: DataFrame | None, force: bool = False) -> DataFrame:
    """(would_index, would_embed) of a run over `notes` (path, body_hash): all notes are indexed; those are
    embedded that are new or changed or, by vectors_of (note_path), not fully embedded."""
    rows = notes.select("path", "body_hash")
    if old is None or vectors_of is None or force:
        return rows.agg(F.count("*").alias("would_index"), F.count("*").alias("would_embed"))
    rows = rows.join(old.select("path", F.col("body_hash").alias("old_hash")), "path", "left")
    rows = rows.join(vectors_of.select(F.col("note_path").alias("path"), F.lit(True).alias("done")), "path", "left")
    changed = ~F.col("body_hash").eqNullSafe(F.col("old_hash")) | F.col("done").isNull()
    return rows.agg(F.count("*").alias("would_index"), F.count_if(changed).alias("would_embed"))


def project(spark: SparkSession, catalog: Catalog, root: str, policy: chunking.Policy = chunking.Policy(), relations_key: str = "relations", stem: bool = True, force: bool = False) -> dict:
    """Notes, chunks, resources, edges and the lexical index of the files under `root`, without a model.

    Notes whose body is as it was keep their chunks; a note that can't be read keeps its old row; what
    is no longer there goes, and so do vectors that no chunk needs. Resources are opened only where their size or
    time is new. Returns the report; its `skipped` is a table (path, reason).
    """
    listed = stored(vault.listing(spark, root))
    files = vault.contents(spark, root, vault.note_files(listed))
    parsed = stored(frontmatter.notes(files, relations_key))
    skipped = parsed.filter("reason is not null").select("path", "reason")
    notes = parsed.filter("reason is null").drop("reason")
    old_notes, old_chunks, m = catalog.table("notes"), catalog.table("chunks"), catalog.manifest()
    held = 0
    if old_notes is not None:
        notes = notes.unionByName(old_notes.join(skipped.select("path"), "path", "left_semi"))
        held = old_notes.join(notes.select("path"), "path", "left_anti").count()
    if old_notes is None or force or m.get("policy") != repr(policy):
        chunks = chunking.chunks(notes, policy)
    else:
        same = notes.join(old_notes.select("path", "body_hash"), ["path", "body_hash"], "left_semi").select("path")
        fresh = chunking.chunks(notes.join(same, "path", "left_anti"), policy)
        chunks = fresh.unionByName(old_chunks.join(same.select(F.col("path").alias("note_path")), "note_path", "left_semi"))
    old_resources = catalog.table("resources")
    opened = vault.unread(listed, old_resources).count()
    resources = stored(vault.inventory(spark, root, listed, old_resources))
    gone = 0 if old_resources is None else old_resources.join(resources.select("path"), "path", "left_anti").count()
    edges = graph.edges(graph.resolve(graph.body_links(notes), notes, resources), graph.resolve(graph.relation_links(notes), notes, resources))
    chunks = stored(chunks)  # several tables come from them
    postings, stats = lexical.index(chunks, stem)
    tables = {"notes": notes, "chunks": chunks, "resources": resources, "edges": edges, "postings": postings, "doc_stats": stats}
    vectors = catalog.table("embeddings")
    if vectors is not None:
        tables["embeddings"] = kept = vectors.join(chunks.select("text_hash"), "text_hash", "left_semi")
        tables["note_centroids"] = _centroids(chunks, kept)
    catalog.commit(tables, policy=repr(policy), stem=stem)
    return {"indexed": notes.count(), "skipped": skipped, "notes_pruned": held, "resources_indexed": resources.count(), "resources_opened": opened, "resources_pruned": gone}


def project_notes(spark: SparkSession, catalog: Catalog, files: DataFrame, policy: chunking.Policy = chunking.Policy(), relations_key: str = "relations", stem: bool = True) -> dict[str, list[int]]:
    """Projects notes that the index has, from `files` (path, content), writing the buckets they are in and no others, which
    it returns by table. A note that can't be read keeps its rows.

    What other notes' links mean depends on paths alone, so their edges stay, as do all rows of theirs.
    Chunks' vectors stay where the text does; vectors that nobody needs go at the next `project`.
    """
    at = catalog.touched(files, "path")
    old = catalog.table("notes", at)
    known = files.select("path", "content").join(old.select("path", "mtime"), "path")
    fresh = stored(frontmatter.notes(known, relations_key).filter("reason is null").drop("reason"))
    if fresh.isEmpty():
        return {}
    names = fresh.select("path")
    rest = lambda name: catalog.table(name, at).join(names.withColumnRenamed("path", schemas.KEYS[name]), schemas.KEYS[name], "left_anti")
    chunks = stored(chunking.chunks(fresh, policy))
    # a changed note is where it was, so all paths are those of the index
    notes, resources = catalog.table("notes"), catalog.table("resources")
    edges = graph.edges(graph.resolve(graph.body_links(fresh), notes, resources), graph.resolve(graph.relation_links(fresh), notes, resources))
    postings, stats = lexical.index(chunks, stem)
    new = {"notes": fresh, "chunks": chunks, "edges": edges, "postings": postings, "doc_stats": stats}
    vectors = catalog.table("embeddings")
    if vectors is not None:
        new["note_centroids"] = _centroids(chunks, vectors)
    return catalog.commit({}, replace={name: (rest(name).unionByName(rows), at) for name, rows in new.items()})


def _centroids(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Centroids of the fully embedded notes."""
    whole = chunks.join(fully_embedded(chunks, vectors), "note_path", "left_semi")
    return discover.centroids(whole.join(vectors, "text_hash").select("note_path", "seq", "vector"))


def embed(catalog: Catalog, embedder: embedders.Embedder, slices: int = 1, stop: Callable[[], bool] | None = None, tag: str | None = None, progress: Callable[[int, int], None] | None = None) -> dict:
    """Vectors for all chunks that have none, and the centroids. Vectors of another model or size go first.

    The texts are embedded in `slices`, by their hash, and each is committed before the next begins, so that a run that
    ends early leaves whole slices, and the next run makes the others alone. `stop` is asked before each slice;
    cancelling the jobs that carry `tag` ends the slice that runs. `progress` hears (slices done, slices). Returns
    {embedded, cancelled}: how many vectors were made, and whether it ended early.
    """
    spark, chunks, m = catalog.spark, catalog.table("chunks"), catalog.manifest()
    vectors = catalog.table("embeddings") if (m.get("model"), m.get("dim")) == (embedder.model_id, embedder.dim) else None
    if vectors is None:
        # an empty space of this model, so that slices only add to it
        empty = spark.createDataFrame([], schemas.EMBEDDINGS)
        catalog.commit({"embeddings": empty, "note_centroids": _centroids(chunks.limit(0), empty)}, model=embedder.model_id, dim=embedder.dim)
    made, cancelled = 0, False
    if tag is not None:
        spark.sparkContext.addJobTag(tag)
    try:
        todo = stored(pending(chunks, vectors).select("note_path", "seq", "text_hash", "text"))
        for n in range(slices):
            if stop is not None and stop():
                cancelled = True
                break
            own = todo if slices == 1 else todo.filter(F.pmod(F.xxhash64("text_hash"), slices) == n)
            fresh = stored(embedders.embedded(own, embedder))
            new = fresh.count()
            if new:
                with_new = catalog.table("embeddings").unionByName(fresh)
                at = catalog.touched(own, "note_path")
                here = catalog.table("chunks", at)
                middle = stored(_centroids(here.join(own.select("note_path").distinct(), "note_path", "left_semi"), with_new))
                left = catalog.table("note_centroids", at).join(middle.select("note_path"), "note_path", "left_anti")
                catalog.commit({}, replace={"note_centroids": (left.unionByName(middle), at)}, append={"embeddings": fresh})
            made += new
            if progress is not None:
                progress(n + 1, slices)
    except Exception as e:
        if tag is None or "cancel" not in str(e).lower():
            raise
        cancelled = True
    finally:
        if tag is not None:
            spark.sparkContext.removeJobTag(tag)
    return {"embedded": made, "cancelled": cancelled}


def reindex(spark: SparkSession, catalog: Catalog, root: str, embedder: embedders.Embedder, **options) -> dict:
    report = project(spark, catalog, root, **options)
    return report | embed(catalog, embedder)
