"""The one class a user of the engine holds: a folder of notes and its index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import chunking, embedders, frontmatter
from quillspark.functions import text as t
from quillspark.functions.vectors import cosine
from quillspark.operators import changes, discover, graph, lexical, search
from quillspark.plans import chat, ingest, mutate
from quillspark.sources import edits, vault
from quillspark.sources.catalog import Catalog
from quillspark.sources.store import stored


class NotFound(LookupError):
    """No such note or resource."""


class ModelMismatch(RuntimeError):
    """The index was embedded by another model."""


class Vault:
    """Notes under `root`, tables under `index`. Reads before any projection are empty; an unknown note
    is an error; a note without rows is an empty result."""

    #: Bars of evidence by model: words' coverage and cosine. A model without one gives no verdict.
    BARS = {"bge-base-en-v1.5": (0.20, 0.54)}
    # The models that may be chosen, and the length of their vectors.
    MODELS = {"BAAI/bge-base-en-v1.5": 768, "BAAI/bge-small-en-v1.5": 384}

    def __init__(self, spark: SparkSession, root: str, index: str, embedder: embedders.Embedder | None = None, policy: chunking.Policy = chunking.Policy(), relations_key: str = "relations", stem: bool = True, buckets: int = 32):
        if embedder is not None and self.MODELS.get(embedder.model_id, embedder.dim) != embedder.dim:
            raise ModelMismatch(f"{embedder.model_id} has vectors of {self.MODELS[embedder.model_id]}, not of {embedder.dim}")
        self.spark, self.root, self.catalog = spark, root, Catalog(spark, index, buckets)
        self.recover()
        self.embedder, self.options = embedder, {"policy": policy, "relations_key": relations_key, "stem": stem}

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.catalog.table(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _notes(self) -> DataFrame:
        return self._table("notes", "path string, created string, body string, body_hash string, title string")

    def _edges(self) -> DataFrame:
        return self._table("edges", "id string, src_path string, dst_path string, dst_resource_path string, dst_path_raw string, type string, origin string, explanation string, embed boolean, caption string, occurrence_index int")

    def project(self, force: bool = False) -> dict:
        return ingest.project(self.spark, self.catalog, self.root, force=force, **self.options)

    def embed(self, slices: int = 1, stop: Callable[[], bool] | None = None, tag: str | None = None, progress: Callable[[int, int], None] | None = None) -> dict:
        """{embedded, cancelled}, see ingest.embed: in committed slices, which `stop` or cancelling the jobs of `tag` ends."""
        return ingest.embed(self.catalog, self.embedder, slices, stop, tag, progress)

    def reindex(self, force: bool = False, slices: int = 1, stop: Callable[[], bool] | None = None, tag: str | None = None) -> dict:
        return self.project(force) | self.embed(slices, stop, tag)

    def reconcile(self, changed: DataFrame) -> dict:
        """Brings the index to the folder's state after `changed` (path, change, hash). Notes that only changed are projected alone,
        in the buckets they are in; a file that came, went or was renamed may be what any note links to, so then all is
        projected. Returns how many files were created, changed, deleted and renamed, and which way it went."""
        kinds = {r["change"]: r["count"] for r in changes.renamed(changed).groupBy("change").count().collect()}
        report = {k: kinds.get(k, 0) for k in ("created", "changed", "deleted", "renamed")}
        known = self.catalog.table("notes")
        other = changed.filter("change <> 'changed'")
        alone = known is not None and other.isEmpty() and changed.filter(~vault.is_note()).isEmpty() and changed.join(known, "path", "left_anti").isEmpty()
        if alone:
            listed = changed.select("path", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
            files = stored(vault.contents(self.spark, self.root, listed).filter("reason is null").select("path", "content"))
            ingest.project_notes(self.spark, self.catalog, files, **self.options)
        else:
            self.project()
        if self.embedder is not None:
            report |= self.embed()
        return report | {"whole": not alone}

    def status(self) -> DataFrame:
        chunks = self._table("chunks", "note_path string, seq int, text_hash string")
        return ingest.status(chunks, self.catalog.table("embeddings"))

    def resolve(self, ref: str) -> str:
        """The path of a note; .md may be left out."""
        found = self._notes().filter(F.col("path").isin(ref, f"{ref}.md")).select("path").orderBy(F.length("path")).first()
        if found is None:
            raise NotFound(ref)
        return found["path"]

    def _vectors(self) -> DataFrame | None:
        """(note_path, seq, vector), or None without a space; another model's space is an error."""
        found = self.catalog.table("embeddings")
        if found is None:
            return None
        m = self.catalog.manifest()
        if self.embedder and (m["model"], m["dim"]) != (self.embedder.model_id, self.embedder.dim):
            raise ModelMismatch(f"{m['model']} of {m['dim']}, not {self.embedder.model_id} of {self.embedder.dim}")
        return self.catalog.table("chunks").join(found, "text_hash").select("note_path", "seq", "vector")

    def _asked(self, queries: list[str], embed: bool) -> DataFrame:
        rows = [(n, q, [float(x) for x in self.embedder.embed_query(q)] if embed else None) for n, q in enumerate(queries)]
        return self.spark.createDataFrame(rows, "query_id long, query string, query_vector array<float>")

    def _hits(self, queries: list[str], width: int) -> tuple[DataFrame, DataFrame] | None:
        if self.catalog.table("chunks") is None or not queries:
            return None
        vectors = self._vectors() if self.embedder else None
        asked = self._asked(queries, vectors is not None)
        return search.hybrid(self.catalog.table("postings"), self.catalog.table("doc_stats"), vectors, asked, width, self.catalog.manifest()["stem"]), asked

    def search(self, queries: list[str], limit: int = 10) -> DataFrame:
        """(query_id, path, title, score, snippet, rank, bm25_rank, vector_rank, cos, best_cos): notes."""
        found = self._hits(queries, search.note_pool(limit)) if limit > 0 else None
        if found is None:
            return self.spark.createDataFrame([], "query_id long, path string, title string, score double, snippet string, rank int, bm25_rank int, vector_rank int, cos double, best_cos double")
        return search.note_view(found[0], self.catalog.table("chunks"), found[1], limit)

    def passages(self, queries: list[str], limit: int = 10) -> DataFrame:
        found = self._hits(queries, search.passage_pool(limit)) if limit > 0 else None
        if found is None:
            return self.spark.createDataFrame([], "query_id long, path string, heading_path string, score double, text string, rank int")
        return search.passage_view(found[0], self.catalog.table("chunks"), limit)

    def evidence(self, queries: list[str]) -> DataFrame:
        """(query_id, pos, term, df, idf, coverage, chunk_total): what the words say, whatever the limit."""
        words = lexical.query_words(self._asked(queries, False), self.catalog.manifest()["stem"])
        return lexical.evidence(self.catalog.table("postings"), self.catalog.table("doc_stats"), words)

    def search_evidence(self, queries: list[str], limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """The rows of `search`, and (query_id, vouched, coverage, best_cos, chunk_total, terms) for every query.
        vouched is null without a bar for the model of the vectors; without vectors words alone decide."""
        results = self.search(queries, limit)
        if self.catalog.table("postings") is None:
            return results, self.spark.createDataFrame([], "query_id long, vouched boolean, coverage double, best_cos double, chunk_total long, terms array<struct<term: string, df: long, idf: double>>")
        m, vectors = self.catalog.manifest(), self._vectors() if self.embedder else None
        asked = self._asked(queries, vectors is not None)
        terms = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "df", "idf"))), lambda x: F.struct(x["term"].alias("term"), x["df"].alias("df"), x["idf"].alias("idf")))
        words = self.evidence(queries).groupBy("query_id").agg(F.first("coverage").alias("coverage"), terms.alias("terms"))
        total = self.catalog.table("doc_stats").count()
        rows = asked.select("query_id").join(words, "query_id", "left")
        if vectors is None:
            rows = rows.withColumn("best_cos", F.lit(None).cast("double"))
        else:
            near = search.nearest(vectors, asked.select("query_id", "query_vector"), 1)
            rows = rows.join(near.select("query_id", cosine(F.col("d2")).alias("best_cos")), "query_id", "left")
        bar = self.BARS.get(str(m.get("model", "")).rpartition("/")[2])
        vouched = lexical.vouched(F.col("coverage"), F.col("best_cos"), *bar) if bar else F.lit(None).cast("boolean")
        return results, rows.select("query_id", vouched.alias("vouched"), "coverage", "best_cos", F.lit(total).cast("long").alias("chunk_total"), F.coalesce("terms", F.array()).alias("terms"))

    def search_vectors(self, queries: list[str], limit: int = 10) -> DataFrame:
        """(query_id, path, title, score, rank): notes by meaning alone; empty without vectors."""
        vectors = self._vectors() if self.embedder else None
        if vectors is None or limit <= 0 or not queries:
            return self.spark.createDataFrame([], "query_id long, path string, title string, score double, rank int")
        return search.vector_view(vectors, self._asked(queries, True), limit)

    def similar(self, refs: list[str], limit: int = 10) -> DataFrame:
        """Near notes that aren't linked, with the chunk that is nearest; the model that made the space decides whether they are graded."""
        anchors = self.spark.createDataFrame([(self.resolve(r),) for r in refs], "anchor string")
        vectors = self.catalog.table("embeddings")
        if vectors is None or limit <= 0:
            return self.spark.createDataFrame([], "anchor string, path string, title string, seq int, excerpt string, d2 double, score double, z double, band string, rank int")
        rows = self.catalog.table("chunks").join(vectors, "text_hash").select("note_path", "seq", "vector")
        linked = self._edges().filter("dst_path is not null").select(F.col("src_path").alias("a"), F.col("dst_path").alias("b"))
        near = discover.similar(rows, self.catalog.table("note_centroids"), linked, anchors, limit, not str(self.catalog.manifest()["model"]).startswith("fake"))
        texts = self.catalog.table("chunks").select(F.col("note_path").alias("path"), "seq", t.head_snippet(F.col("text")).alias("excerpt"))
        return near.join(texts, ["path", "seq"]).select("anchor", "path", t.title(F.col("path")).alias("title"), "seq", "excerpt", "d2", "score", "z", "band", "rank")

    def neighbors(self, ref: str) -> DataFrame:
        anchor = self.spark.createDataFrame([(self.resolve(ref),)], "anchor string")
        return graph.neighbors(self._edges(), self._notes(), anchor)

    def unresolved(self, ref: str) -> DataFrame:
        return graph.dangling(self._edges().filter(F.col("src_path") == self.resolve(ref)))

    def within(self, query: str, ref: str, hops: int, limit: int = 10) -> DataFrame:
        """The nearest chunks among notes within so many edges of a note."""
        anchor = self.spark.createDataFrame([(self.resolve(ref),)], "anchor string")
        vectors = self._vectors()
        if vectors is None:
            return self.spark.createDataFrame([], "query_id long, note_path string, seq int, d2 double, rank int")
        return search.within(vectors, graph.reachable(self._edges(), anchor, hops), self._asked([query], True), limit)

    # reads for display

    def list_notes(self) -> DataFrame:
        return self._notes().select("path", F.coalesce("title", t.title(F.col("path"))).alias("title")).orderBy("path")

    def list_resources(self) -> DataFrame:
        return self._table("resources", schemas.RESOURCES).select("path", "class", "size", "mtime").orderBy("path")

    def list_folders(self) -> list[str]:
        return edits.folders(self.spark, self.root)

    def read(self, ref: str) -> dict:
        """One note as its file has it now: path, the fields of its row, body and frontmatter verbatim, and
        revision, which `write_body` and `write_frontmatter` take."""
        path = self.resolve(ref)
        content = edits.read(self.spark, self.root, path)
        if content is None:
            raise NotFound(path)
        file = self.spark.createDataFrame([(path, content, 0)], "path string, content binary, mtime long")
        row = frontmatter.notes(file, self.options["relations_key"]).join(file.select("path", mutate.revision(F.col("content")).alias("revision"), F.nullif(frontmatter.span(F.col("content").cast("string")), F.lit("")).alias("frontmatter")), "path").drop("mtime", "relations").first()
        if row["reason"] is not None:
            raise NotFound(f"{path} {row['reason']}")
        return {k: v.toPython() if k == "properties" else v for k, v in row.asDict().items() if k != "reason"}

    def explain(self, ref: str) -> dict[str, DataFrame]:
        """What a note is tied to: connections, resources and unresolved, a frame each."""
        path = self.resolve(ref)
        anchor = self.spark.createDataFrame([(path,)], "anchor string")
        own = self._edges().filter(F.col("src_path") == path)
        return {"connections": graph.neighbors(self._edges(), self._notes(), anchor), "resources": graph.file_links(own, self._table("resources", schemas.RESOURCES)), "unresolved": graph.dangling(own)}

    def explain_resource(self, path: str) -> tuple[dict, DataFrame]:
        """(path, class, size, mtime and content_hash of a resource, the notes that link it)."""
        row = self._table("resources", schemas.RESOURCES).filter(F.col("path") == path).first()
        if row is None:
            raise NotFound(path)
        return row.asDict(), graph.backlinks(self._edges().filter(F.col("dst_resource_path") == path), self._notes())

    def plan_reindex(self, force: bool = False) -> DataFrame:
        """(would_index, would_embed) of a run over the files as they are now."""
        parsed = frontmatter.notes(vault.contents(self.spark, self.root, vault.note_files(vault.listing(self.spark, self.root))), self.options["relations_key"])
        chunks, vectors = self.catalog.table("chunks"), self.catalog.table("embeddings")
        whole = None if chunks is None or vectors is None else ingest.fully_embedded(chunks, vectors)
        return ingest.plan(parsed.filter("reason is null"), self.catalog.table("notes"), whole, force)

    def ask(self, question: str, model: Callable[[str, str], Iterator[str]], history: list[tuple[str, str]] = (), rewrite: Callable | None = None, stop: Callable[[], bool] | None = None) -> DataFrame:
        """(query_id, answer, cancelled, citations) of a question after `history` (role, text): condensed by
        `rewrite`, grounded in the ten best passages, answered by `model`; `stop` is asked between tokens."""
        turns = [(0, n, role, text) for n, (role, text) in enumerate([*history, ("user", question)])]
        asked = chat.questions(self.spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), rewrite)
        query = asked.first()["query"]
        return chat.answers(chat.prompts(asked, self.passages([query], chat.PASSAGES)), model, stop)

    # changes: the folder first, then the index

    def _files(self, paths: list[str]) -> DataFrame:
        rows = [(p, c) for p, c in ((p, edits.read(self.spark, self.root, p)) for p in paths) if c is not None]
        return self.spark.createDataFrame(rows, "path string, content binary")

    def _put(self, path: str, before: DataFrame, after: DataFrame) -> str:
        """Writes the one note that changed, projects it alone, and returns its revision."""
        row = after.filter(F.col("path") == path).select("path", "content", mutate.revision(F.col("content")).alias("revision")).first()
        alone = not before.isEmpty() and path.lower().endswith(".md")
        self._apply(self.spark.createDataFrame([row[:2]], "path string, content binary"), then=(lambda: self.project_note(path)) if alone else self.project)
        return row["revision"]

    def _apply(self, contents: DataFrame | None = None, renames: list[tuple[str, str]] = (), gone: list[str] = (), then: Callable[[], object] | None = None) -> list[str]:
        """Changes the folder and brings the index up to it: both, or neither."""
        return edits.apply(self.spark, self.root, contents, renames, gone, then or self.project, self.catalog.number())

    def recover(self) -> dict[str, int]:
        """What a process that died in the middle of a change has left is finished, if the index has it, or undone."""
        return edits.recover(self.spark, self.root, self.catalog.number())

    def _kinds(self, listed: DataFrame) -> tuple[int, int]:
        """How many of the files are notes, and how many resources."""
        n = listed.agg(F.count_if(vault.is_note()).alias("notes"), F.count("*").alias("all")).first()
        return n["notes"], n["all"] - n["notes"]

    def project_note(self, ref: str, embed: bool = False) -> dict:
        """Projects one known note anew and leaves the rows of all others; with `embed`, its vectors too."""
        path = self.resolve(ref)
        content = edits.read(self.spark, self.root, path)
        if content is None:
            raise NotFound(path)
        file = self.spark.createDataFrame([(path, content)], "path string, content binary")
        wrote = ingest.project_notes(self.spark, self.catalog, file, **self.options)
        return {"indexed": 1, "buckets": wrote} | (self.embed() if embed else {})

    def add(self, path: str, text: str | bytes) -> dict:
        """A new note or resource, by its text or imported bytes."""
        before = self._files([path])
        after = mutate.add(before, path, text)
        return {"path": path, "revision": self._put(path, before, after)}

    def create_note(self, path: str, today: str, kind: str | None = None) -> dict:
        name = path.rpartition("/")[2].removesuffix(".md")
        return self.add(path if path.endswith(".md") else f"{path}.md", mutate.template(name, today, kind))

    def create_folder(self, path: str) -> None:
        if not edits.make_folder(self.spark, self.root, mutate.checked(path)):
            raise mutate.Refused(f"there already: {path}")

    def write_body(self, ref: str, body: str, expected: str | None = None) -> dict:
        path = self.resolve(ref)
        before = self._files([path])
        return {"path": path, "revision": self._put(path, before, mutate.write_body(before, path, body, expected))}

    def write_frontmatter(self, ref: str, block: str, expected: str | None = None) -> dict:
        path = self.resolve(ref)
        before = self._files([path])
        return {"path": path, "revision": self._put(path, before, mutate.write_frontmatter(before, path, block, expected))}

    def link(self, src: str, verb: str, dst: str, explanation: str | None = None) -> dict:
        """Relates two notes in the first one's frontmatter; `created` is False where it was so already."""
        a, b = self.resolve(src), self.resolve(dst)
        before = self._files([a])
        after = mutate.relate(before, a, verb, b, explanation, self.options["relations_key"])
        created = before.first()["content"] != after.first()["content"]
        if created:
            self._put(a, before, after)
        return {"src_path": a, "dst_path": b, "relation": verb, "created": created}

    def move(self, old: str, new: str, folder: bool | None = None) -> dict:
        """A note, a resource or a whole folder to another place, links to it with it; unless `folder` says which, what stands
        at the place decides. The report has the notes that were rewritten, by the places they have now, how many links that
        took, and the notes that link to it without having moved (`touched`)."""
        if folder is None:
            folder = edits.is_folder(self.spark, self.root, old)
            old, new = (old.rstrip("/"), new.rstrip("/")) if folder else (old, new)
        mutate.checked(old), mutate.checked(new)
        hit = (lambda c: c.startswith(f"{old}/")) if folder else (lambda c: c == old)
        dst = F.coalesce("dst_path", "dst_resource_path")
        own = self._edges().filter(dst.isNotNull() & (hit(dst) | hit(F.col("src_path"))))
        sources = [r["src_path"] for r in own.select("src_path").distinct().collect()]
        before = vault.files(self.spark, self.root, sources).select("path", "content")
        if not edits.exists(self.spark, self.root, old):
            raise mutate.Refused(f"not there: {old}")
        if edits.exists(self.spark, self.root, new) and old.lower() != new.lower():
            raise mutate.Refused(f"there already: {new}")
        if folder:
            # only names count of the files that just move along
            notes, resources = self._kinds(vault.listing(self.spark, self.root).filter(hit(F.col("path"))))
            after, _ = mutate.move_folder(before, own, old, new)
        else:
            before = before.unionByName(self._files([old] if old not in sources else []))
            after, _ = mutate.move(before, own, old, new)
        place = F.when(hit(F.col("path")), F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20))).otherwise(F.col("path"))
        was = before.select(place.alias("path"), F.col("content").alias("_was"))
        changed = after.join(was, "path").filter(F.col("content") != F.col("_was")).select("path", "content")
        links = own.filter(hit(dst)).count()
        touched = [r["src_path"] for r in own.filter(hit(dst) & ~hit(F.col("src_path"))).select("src_path").distinct().orderBy("src_path").collect()]
        rewrote = self._apply(changed, [(old, new)])
        return {"from": old, "to": new, "rewrote": rewrote, "links_rewritten": links, "touched": touched} | ({"moved": notes + resources, "moved_notes": notes, "moved_resources": resources} if folder else {})

    def delete(self, path: str, folder: bool | None = None) -> dict:
        """Takes a note, a resource or a whole folder away; unless `folder` says which, what stands at the place decides.
        `dangled` are the notes whose links now lead nowhere."""
        if folder is None:
            folder = edits.is_folder(self.spark, self.root, path)
            path = path.rstrip("/") if folder else path
        listed = vault.listing(self.spark, self.root).select("path")
        left, dangled = mutate.delete(listed, self._edges(), path, folder)
        notes, resources = self._kinds(listed.join(left, "path", "left_anti"))
        sources = [r["path"] for r in dangled.collect()]
        self._apply(gone=[mutate.checked(path)])
        return {"path": path, "deleted": notes + resources, "deleted_notes": notes, "deleted_resources": resources, "dangled": sources}
