"""A folder of notes from end to end: incremental runs equal full ones, changes, chat and streams."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import embedders
from quillspark.functions import text as t
from quillspark.operators import graph
from quillspark.plans import chat, engine, mutate
from quillspark.sources import edits
from quillspark.sources import vault as source
from quillspark.streaming import watch

NOTES = {
    "concepts/memory.md": "# Memory\n\nForgetting is steep at first.\n",
    "notes/repetition.md": "---\ntype: idea\nrelations:\n  - \"supports [[concepts/memory|it]] — the curve\"\n---\n# Spaced repetition\n\nSee [[concepts/memory]] and ![chart](../files/curve.png), [[gone]].\n",
    "notes/other.md": "Reviews spaced in time. [m](../concepts/memory.md#top)\n",
    "files/curve.png": "png",
    "files/data.txt": "1,2\n",
    ".hidden/x.md": "[[concepts/memory]]",
}


def write(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode() if isinstance(text, str) else text)


@pytest.fixture
def made(spark, tmp_path):
    root = tmp_path / "vault"
    write(root, NOTES)
    v = engine.Vault(spark, str(root), f"file://{tmp_path}/index", embedders.FakeEmbedder(8))
    return root, v


def dump(v):
    """All tables without what a run alone decides."""
    drop = {"mtime", "reason"}
    out = {}
    for name in ("notes", "chunks", "resources", "edges", "postings", "doc_stats", "embeddings", "note_centroids"):
        df = v.catalog.table(name)
        out[name] = None if df is None else sorted(map(str, df.select(*sorted(set(df.columns) - drop)).collect()))
    return out


def test_project_and_read(spark, made):
    root, v = made
    assert v.search(["memory"]).count() == 0 and v.status().first()["total"] == 0
    report = v.reindex()
    assert (report["indexed"], report["resources_indexed"], report["resources_opened"], report["skipped"].count(), report["embedded"]) == (3, 2, 2, 0, 3)
    got = [(r["path"], r["label"]) for r in v.neighbors("concepts/memory").orderBy("at").collect()]
    assert got == [("notes/other.md", "referenced-by"), ("notes/repetition.md", "referenced-by"), ("notes/repetition.md", "supported-by")]
    assert [r["target"] for r in v.unresolved("notes/repetition").collect()] == ["gone"]
    why = v.catalog.table("edges").filter("type = 'supports'").first()
    assert (why["explanation"], why["caption"], why["origin"]) == ("the curve", "it", "frontmatter")
    assert [r["dst_resource_path"] for r in v.catalog.table("edges").filter("embed").collect()] == ["files/curve.png"]
    found = v.search(["spaced reviews"], 2).orderBy("rank").collect()
    assert {r["path"] for r in found} <= {"notes/other.md", "notes/repetition.md", "concepts/memory.md"} and found[0]["bm25_rank"] is not None and len(found) == 2
    assert v.passages(["forgetting"], 1).count() == 1 and v.search(["x"], 0).count() == 0
    assert v.status().first()["embedded"] == 3 and v.evidence(["steep nothing"]).count() == 2
    assert v.similar(["concepts/memory"]).count() == 0  # its only neighbours are linked
    assert v.within("steep", "concepts/memory", 1).count() == 3
    with pytest.raises(engine.NotFound):
        v.neighbors("nowhere")
    v.embedder = embedders.FakeEmbedder(4)
    with pytest.raises(engine.ModelMismatch):
        v.search(["memory"])
    assert {r["path"] for r in source.listing(spark, str(root)).collect()} == set(NOTES) - {".hidden/x.md"}
    assert [r["folder"] for r in source.folders(source.listing(spark, str(root))).collect()] == ["concepts", "files", "notes"]


def test_incremental_equals_full(spark, made, tmp_path):
    root, v = made
    v.reindex()
    r = random.Random(3)
    for step in range(4):
        name = f"notes/n{r.randrange(3)}.md"
        if step == 2:
            (root / "notes/other.md").unlink()
        else:
            write(root, {name: f"# N\n\nText {r.random()} [[concepts/memory]]\n", "files/data.txt": f"{r.random()}"})
        v.reindex()
        full = engine.Vault(spark, str(root), f"file://{tmp_path}/full{step}", embedders.FakeEmbedder(8))
        full.reindex()
        assert dump(v) == dump(full)
    v.catalog.vacuum()
    assert dump(v) == dump(full)


def test_unreadable_note_keeps_its_row(made):
    root, v = made
    v.reindex()
    (root / "notes/other.md").write_bytes(b"\xff\xfe")
    report = v.project()
    assert [tuple(r) for r in report["skipped"].collect()] == [("notes/other.md", "is not valid UTF-8")] and report["notes_pruned"] == 0
    assert v.catalog.table("notes").filter("path = 'notes/other.md'").first()["body"].startswith("Reviews")


def test_another_model_starts_anew(made):
    _, v = made
    v.reindex()
    v.embedder = embedders.FakeEmbedder(4)
    assert v.embed() == {"embedded": 3, "cancelled": False} and v.catalog.manifest()["dim"] == 4 and v.embed()["embedded"] == 0


def table(spark, files):
    return spark.createDataFrame([(k, x.encode()) for k, x in files.items() if not k.startswith(".")], "path string, content binary")


def text(df, path):
    return bytes(df.filter(F.col("path") == path).first()["content"]).decode()


def test_moves_keep_backlinks(spark, made):
    root, v = made
    v.project()
    edges, files = v.catalog.table("edges"), table(spark, NOTES)
    moved, rewritten = mutate.move(files, edges, "concepts/memory.md", "ideas/recall.md")
    assert {r["path"] for r in rewritten.collect()} == {"notes/repetition.md", "notes/other.md"}
    assert text(moved, "ideas/recall.md") == NOTES["concepts/memory.md"]
    after = text(moved, "notes/repetition.md")
    assert "[[ideas/recall|it]]" in after and "[[ideas/recall]]" in after and "[[gone]]" in after
    for path in ("concepts/memory.md", ".x.md", "a/../b.md", "notes/other.md"):
        with pytest.raises(mutate.Refused):
            mutate.move(files, edges, "concepts/memory.md", path)
    folder, _ = mutate.move_folder(files, edges, "concepts", "deep/ideas")
    assert "[[deep/ideas/memory]]" in text(folder, "notes/repetition.md") and {r["path"] for r in folder.collect()} >= {"deep/ideas/memory.md"}


def test_other_changes(spark, made):
    _, v = made
    v.project()
    edges, files = v.catalog.table("edges"), table(spark, NOTES)
    left, dangled = mutate.delete(files, edges, "concepts/memory.md")
    assert left.count() == 4 and [r["path"] for r in dangled.collect()] == ["notes/other.md", "notes/repetition.md"]
    more = mutate.add(files, "notes/new.md", mutate.template('A "b"', "2026-01-02", "idea"))
    assert text(more, "notes/new.md") == '---\ntype: idea\ntitle: "A \\"b\\""\ncreated: 2026-01-02\nupdated: 2026-01-02\n---\n\n'
    with pytest.raises(mutate.Refused):
        mutate.add(files, "notes/other.md", "")
    new = mutate.write_body(files, "notes/repetition.md", "changed\n")
    assert text(new, "notes/repetition.md").endswith("---\nchanged\n") and text(new, "notes/repetition.md").startswith("---\ntype: idea")
    with pytest.raises(mutate.Refused):
        mutate.write_body(files, "notes/other.md", "x", expected="stale")
    with pytest.raises(mutate.Refused):
        mutate.write_frontmatter(files, "notes/other.md", "a: 1\n---\nb: 2")
    assert text(mutate.write_frontmatter(files, "notes/other.md", "a: 1"), "notes/other.md") == "---\na: 1\n---\n" + NOTES["notes/other.md"]
    tied = mutate.relate(files, "notes/other.md", "contradicts", "concepts/memory.md", "so")
    assert text(tied, "notes/other.md").startswith('---\nrelations:\n  - "contradicts [[concepts/memory]] — so"\n---\nReviews')
    again = mutate.relate(mutate.relate(files, "notes/repetition.md", "contradicts", "x"), "notes/repetition.md", "contradicts", "x")
    assert text(again, "notes/repetition.md").count("contradicts [[x]]") == 1 and "supports [[concepts/memory|it]]" in text(again, "notes/repetition.md")


def test_chat(spark):
    turns = spark.createDataFrame([(1, 1, "user", "what is it"), (2, 1, "user", "first"), (2, 2, "assistant", "yes"), (2, 3, "user", "and then")], "conv_id long, turn long, role string, text string")
    asked = chat.questions(turns, lambda talks: [None if "first" not in x else "first and then" for x in talks])
    assert {r["query_id"]: r["query"] for r in asked.collect()} == {1: "what is it", 2: "first and then"}
    passages = spark.createDataFrame([(1, "a.md", None, "alpha", 0), (1, "b.md", "H", "beta", 1)], "query_id long, path string, heading_path string, text string, rank int")
    prompted = chat.prompts(asked, passages)
    assert "[1] a.md\nalpha\n\n[2] b.md > H\nbeta" in prompted.filter("query_id = 1").first()["prompt"]

    def model(prompt, question):
        yield "It is [2], "
        if question == "and then":
            raise ConnectionError
        yield "not [7] or [1]."

    got = {r["query_id"]: r for r in chat.answers(prompted, model).collect()}
    assert [(c["marker"], c["path"]) for c in got[1]["citations"]] == [(1, "a.md"), (2, "b.md")] and not got[1]["cancelled"]
    assert (got[2]["answer"], got[2]["cancelled"], got[2]["citations"]) == ("It is [2], ", True, [])


def test_stream_reconciles(spark, made, tmp_path):
    root, v = made
    changes = watch.changed_files(spark, str(root))
    run = lambda: watch.reconcile(changes, v.project, v.embed, f"file://{tmp_path}/cp", once=True).awaitTermination(120)
    assert run() and v.status().first()["embedded"] == 3
    time.sleep(1.1)
    write(root, {"notes/late.md": "Late [[concepts/memory]]\n", ".git/y.md": "no"})
    assert run() and v.status().first()["total"] == 4
    assert {r["src_path"] for r in v.catalog.table("edges").collect()} >= {"notes/late.md"}


def test_bursts_on_a_stream(spark, tmp_path):
    rows = [("2026-01-01 00:00:00.0", "a"), ("2026-01-01 00:00:00.2", "b"), ("2026-01-01 00:00:01.0", "c"), ("2026-01-01 00:01:00.0", "d")]
    spark.createDataFrame(rows, "ts string, path string").select(F.to_timestamp("ts").alias("ts"), "path").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, path string").parquet(f"file://{tmp_path}/in")
    q = watch.bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["changes"] for r in spark.table("bursts").collect()) == [1, 2]


def test_resolution(spark):
    notes = spark.createDataFrame([("a/b.md", None), ("b.md", None)], "path string, created string")
    files = spark.createDataFrame([("a/2026.07.14-log", "binary")], "path string, class string")
    links = spark.createDataFrame([("a/n.md", 0, "b", True), ("a/n.md", 1, "b", False), ("a/n.md", 2, "b.md#x", True), ("a/n.md", 3, "../../z", True), ("a/n.md", 4, "a/2026.07.14-log", False), ("a/n.md", 5, "2026.07.14-note", False), ("a/n.md", 6, "#top", False)], "src_path string, pos int, target string, md boolean").selectExpr("*", "'inline' AS origin")
    got = {r["pos"]: r["dst_path"] or r["dst_resource_path"] for r in graph.resolve(links, notes, files).collect()}
    assert got == {0: "a/b.md", 1: "b.md", 2: "a/b.md", 3: None, 4: "a/2026.07.14-log", 5: None, 6: None}


def test_facade_reads(spark, made):
    root, v = made
    with pytest.raises(engine.NotFound):
        v.read("concepts/memory")
    assert v.list_notes().count() == 0 and v.search_evidence(["memory"])[1].count() == 0 and v.search_vectors(["memory"]).count() == 0
    v.reindex()
    write(root, {"_drafts/_x.md": "draft"})
    (root / "empty/deep").mkdir(parents=True)
    note = v.read("notes/repetition")
    assert (note["path"], note["type"], note["readable"]) == ("notes/repetition.md", "idea", True)
    assert note["frontmatter"] + note["body"] == NOTES["notes/repetition.md"] and len(note["revision"]) == 64
    assert v.read("notes/other")["frontmatter"] is None
    why = v.explain("notes/repetition")
    assert {r["path"] for r in why["connections"].collect()} == {"concepts/memory.md"}
    assert [r["path"] for r in why["resources"].collect()] == ["files/curve.png"] and [r["target"] for r in why["unresolved"].collect()] == ["gone"]
    own, links = v.explain_resource("files/curve.png")
    assert (own["class"], own["size"]) == ("image", 3) and [(r["path"], r["embed"]) for r in links.collect()] == [("notes/repetition.md", True)]
    with pytest.raises(engine.NotFound):
        v.explain_resource("files/none.png")
    assert [r["path"] for r in v.list_notes().collect()] == sorted(p for p in NOTES if p.endswith(".md") and p[0] != ".")
    assert [r["path"] for r in v.list_resources().collect()] == ["files/curve.png", "files/data.txt"]
    assert v.list_folders() == ["_drafts", "concepts", "empty", "empty/deep", "files", "notes"]
    plan = v.plan_reindex().first()
    assert (plan["would_index"], plan["would_embed"]) == (4, 1)  # _drafts/_x.md is a note
    results, verdicts = v.search_evidence(["steep zebra", ""], 2)
    got = {r["query_id"]: r for r in verdicts.collect()}
    assert [(x["term"], x["df"]) for x in got[0]["terms"]] == [("steep", 1), ("zebra", 0)] and got[0]["chunk_total"] == 3
    assert got[0]["vouched"] is None and 0 < got[0]["coverage"] < 1 and got[1]["terms"] == [] and results.filter("query_id = 0").count() == 2
    v.BARS = {v.embedder.model_id: (0.1, 2.0)}
    assert {r["query_id"]: r["vouched"] for r in v.search_evidence(["steep zebra", ""])[1].collect()} == {0: True, 1: False}
    near = v.search_vectors(["steep"], 2).orderBy("rank").collect()
    assert len(near) == 2 and near[0]["score"] >= near[1]["score"] and len({r["path"] for r in near}) == 2


def test_ask(made):
    _, v = made
    v.reindex()
    model = lambda prompt, question: iter(["So ", "[1]", "."])
    said = v.ask("why is forgetting steep", model).first()
    assert said["answer"] == "So [1]." and not said["cancelled"] and [c["marker"] for c in said["citations"]] == [1]
    cut = v.ask("and then", model, [("user", "forgetting"), ("assistant", "yes")], lambda talks: ["forgetting"] * len(talks), stop=lambda: True).first()
    assert (cut["answer"], cut["cancelled"]) == ("", True)


def test_event_tokens():
    """Tokens of a stream of events; one that is cut off, in error or garbled leaves what there was and fails."""
    piece = lambda x, end=None: {"choices": [{"delta": {"content": x}, "finish_reason": end}]}

    def said(lines):
        out, whole = [], True
        try:
            for x in chat.event_tokens(lines):
                out.append(x)
        except ConnectionError:
            whole = False
        return "".join(out), whole

    stream = lambda *xs: [line for x in xs for line in (b": still here\n", b"event: m\n", x if isinstance(x, bytes) else b"data: " + json.dumps(x).encode() + b"\r\n", b"\r\n")]
    assert said(stream(piece("It "), piece("is."), b"data: [DONE]\n", piece("late"))) == ("It is.", True)
    assert said(stream(piece("It "), piece("is.", "stop"))) == ("It is.", True)
    assert said(stream(piece("It "), piece("is."))) == ("It is.", False)
    assert said([]) == ("", False)
    assert said(stream(piece("It "), {"error": {"message": "busy"}}, piece("is."))) == ("It ", False)
    assert said(stream(piece("It "), b"data: {nothing\n", piece("is."))) == ("It ", False)
    assert said(stream(piece("It", "stop"))[:-1]) == ("It", True)  # the last event needs no blank line
    halves = [b'data: {"choices": [{"delta":\n', b'data: {"content": "one"}}]}\n', b"\n", b"data:[DONE]\n"]
    assert said(halves) == ("one", True)
    assert said(stream({"choices": []}, {"usage": 3}, piece(None), piece("x"), b"data: [DONE]")) == ("x", True)


def test_fake_model_cites_all_passages(spark, made):
    _, v = made
    v.reindex()
    got = v.ask("spaced reviews", chat.FakeModel()).first()
    assert not got["cancelled"] and [c["marker"] for c in got["citations"]] == list(range(1, len(got["citations"]) + 1)) != []
    none = chat.FakeModel()("no passage at all", "q")
    assert list(none) == [chat.FakeModel.NOTHING]


def test_what_stands_there_decides(spark, made, tmp_path):
    """A folder, a note and a resource move and go by their places alone; links from outside are named."""
    root, v = made
    v.reindex()
    moved = v.move("concepts/", "ideas/")
    assert (moved["moved_notes"], moved["moved_resources"], moved["touched"]) == (1, 0, ["notes/other.md", "notes/repetition.md"])
    assert (root / "ideas/memory.md").exists() and v.resolve("ideas/memory") == "ideas/memory.md"
    one = v.move("files/curve.png", "files/line.png")
    assert "moved" not in one and one["touched"] == ["notes/repetition.md"]
    gone = v.delete("files")
    assert (gone["deleted_notes"], gone["deleted_resources"], gone["dangled"]) == (0, 2, ["notes/repetition.md"])
    assert v.delete("notes/other.md")["deleted_notes"] == 1


def test_known_models_have_their_size(spark, tmp_path):
    small = embedders.FakeEmbedder(8)
    small.model_id = next(iter(engine.Vault.MODELS))
    with pytest.raises(engine.ModelMismatch):
        engine.Vault(spark, str(tmp_path), f"file://{tmp_path}/index", small)


def test_relations_to_quoted_places(spark):
    """Quotes and backslashes in a place and in what is said are written so that they are read back."""
    files = spark.createDataFrame([("a.md", b"body\n")], "path string, content binary")
    once = mutate.relate(files, "a.md", "supports", 'x "y" \\z.md', 'so "it" \\ is')
    twice = mutate.relate(once, "a.md", "supports", 'x "y" \\z.md', "again")
    text = once.first()["content"].decode()
    assert twice.first()["content"].decode() == text
    assert '  - "supports [[x \\"y\\" \\\\z]] — so \\"it\\" \\\\ is"\n' in text


def test_facade_changes(spark, made, tmp_path):
    root, v = made
    v.reindex()

    def same():
        full = engine.Vault(spark, str(root), f"file://{tmp_path}/full-{time.time_ns()}", embedders.FakeEmbedder(8))
        full.reindex()
        v.embed()
        assert dump(v) == dump(full)

    old = v.read("notes/other")["revision"]
    new = v.write_body("notes/other", "Anew: [m](../concepts/memory.md#top), [n](repetition.md), [[concepts/memory.md#a|b]]\n", old)["revision"]
    assert v.read("notes/other")["revision"] == new != old
    with pytest.raises(mutate.Refused):
        v.write_body("notes/other", "late", old)
    assert v.link("notes/other", "supports", "notes/repetition")["created"] and not v.link("notes/other", "supports", "notes/repetition")["created"]
    v.add("notes/extra.md", "See [[gone]].\n")
    v.create_note("gone", "2026-01-02")
    v.create_folder("ideas")
    for change in (lambda: v.create_folder("ideas"), lambda: v.add("gone.md", ""), lambda: v.move("nowhere.md", "x.md"), lambda: v.move("gone.md", "notes/other.md"), lambda: v.delete("nowhere.md"), lambda: v.move("notes", "files", folder=True)):
        with pytest.raises(mutate.Refused):
            change()
    assert v.unresolved("notes/repetition").count() == 0
    report = v.move("concepts/memory.md", "ideas/re[c]all $1.md")
    assert report["rewrote"] == ["notes/other.md", "notes/repetition.md"] and report["links_rewritten"] == v.catalog.table("edges").filter("dst_path = 'ideas/re[c]all $1.md'").count()
    assert "[m](../ideas/re[c]all $1.md#top)" in (root / "notes/other.md").read_text() and "[n](repetition.md)" in (root / "notes/other.md").read_text()
    moved = v.move("notes", "deep/down", folder=True)
    text = (root / "deep/down/other.md").read_text()
    assert moved["moved"] == 3 and "[m](../../ideas/re[c]all $1.md#top)" in text and "[n](repetition.md)" in text and "[[ideas/re[c]all $1.md#a|b]]" in text and "supports [[deep/down/repetition]]" in text
    assert "![chart](../../files/curve.png)" in (root / "deep/down/repetition.md").read_text()
    gone = v.delete("ideas/re[c]all $1.md")
    assert gone["dangled"] == ["deep/down/other.md", "deep/down/repetition.md"] and gone["deleted"] == 1
    assert v.delete("files", folder=True)["deleted"] == 2
    same()
    assert not [p for p in root.rglob(".*") if p.name != ".hidden"]


def test_a_failed_change_is_undone(spark, made):
    root, _ = made
    before = {p: p.read_bytes() for p in root.rglob("*") if p.is_file()}
    new = spark.createDataFrame([("notes/other.md", b"x"), ("a/b.md", b"y")], "path string, content binary")
    with pytest.raises(OSError):
        edits.apply(spark, str(root), new, [("concepts", "ideas")], ["nowhere"])
    assert {p: p.read_bytes() for p in root.rglob("*") if p.is_file()} == before


def test_tree_and_trigger(spark):
    rows = spark.createDataFrame([("b.md",), ("a/x/y.md",), ("A.md",), ("a/c.md",)], "path string")
    got = [(r["parent"], r["path"]) for r in graph.tree(rows).orderBy("parent", "rank").collect()]
    assert got == [("", "a"), ("", "A.md"), ("", "b.md"), ("a", "a/x"), ("a", "a/c.md"), ("a/x", "a/x/y.md")]
    lines = spark.createDataFrame([("see [[me",), ("[[a]] x",), ("[[a|b",), ("no",), ("[[a]] [[",), ("x [[[q",)], "line string")
    assert [r["t"] for r in lines.select(t.trigger(F.col("line")).alias("t")).collect()] == ["me", None, None, None, "", "q"]
