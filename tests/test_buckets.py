"""Tables in buckets, the folder reader, and embedding in slices."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from test_vault import NOTES, dump, write

from quillspark.functions import embedders
from quillspark.plans import engine, ingest
from quillspark.sources import reader
from quillspark.sources import vault as source
from quillspark.sources.catalog import Catalog


def test_one_edited_note_writes_one_bucket(spark, tmp_path):
    root, draw = tmp_path / "vault", random.Random(1)
    (root / "n").mkdir(parents=True)
    for n in range(10_000):
        (root / f"n/{n}.md").write_text(f"# Note {n}\n\nWord{n % 50} see [[n/{draw.randrange(10_000)}]] and [[gone{n % 7}]].\n")
    v = engine.Vault(spark, str(root), f"file://{tmp_path}/index", buckets=16)
    assert v.project()["indexed"] == 10_000
    before = v.catalog.manifest()["tables"]
    (root / "n/77.md").write_text("# Anew\n\nOther words, [[n/5]], [[n/5]] and [[nowhere]].\n")
    wrote = v.project_note("n/77")["buckets"]
    at = v.catalog.touched(spark.createDataFrame([("n/77.md",)], "path string"), "path")
    assert len(at) == 1 and wrote == dict.fromkeys(("notes", "chunks", "edges", "postings", "doc_stats"), at)
    after = v.catalog.manifest()["tables"]
    changed = {(t, b) for t in after for b in after[t]["folders"] if after[t]["folders"][b] != before[t]["folders"].get(b)}
    assert changed == {(t, str(at[0])) for t in wrote}
    full = engine.Vault(spark, str(root), f"file://{tmp_path}/full", buckets=16)
    full.project()
    assert dump(v) == dump(full)


def test_commits_of_parts(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/i", buckets=4)
    rows = spark.range(100).select(F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("v"))
    c.commit({"notes": rows, "resources": rows.limit(0)})
    assert c.table("notes").count() == 100 and c.table("resources").columns == ["path", "v"] and c.table("edges") is None
    for b in range(4):
        assert {r[0] for r in c.table("notes", [b]).select(c.bucket(F.col("path"))).distinct().collect()} == {b}
    kept = c.table("notes", [2]).filter("v % 2 = 0")
    assert c.commit({}, replace={"notes": (kept, [2])}, append={"resources": rows.limit(3)})["notes"] == [2]
    left = c.table("notes").count()
    assert left == 100 - c.table("notes", [2]).count() - rows.filter(c.bucket(F.col("path")) == 2).filter("v % 2 = 1").count() + c.table("notes", [2]).count()
    c.commit({}, append={"resources": rows.limit(3)}, replace={"notes": (rows.limit(0), [1])})
    assert c.table("resources").count() == 6 and c.table("notes", [1]).count() == 0
    with pytest.raises(ValueError):
        c.commit({}, replace={"notes": (rows, [0])})
    was = sorted(map(str, c.table("notes").collect()))
    c.vacuum()
    assert sorted(map(str, c.table("notes").collect())) == was and c.table("resources").count() == 6
    assert Catalog(spark, f"file://{tmp_path}/i", buckets=99).touched(rows, "path") == [0, 1, 2, 3]  # the index's own number


def test_reader(spark, tmp_path, monkeypatch):
    root = tmp_path / "v"
    write(root, NOTES | {"_draft.md": "# D\n", "_x/_y/_z.bin": b"\0\1", "a b/ü.md": "x", ".git/c.md": "no", "a/.h/n.md": "no"})
    os.symlink(root, root / "a b/loop")
    want = {p for p in [*NOTES, "_draft.md", "_x/_y/_z.bin", "a b/ü.md"] if not p.startswith(".")}
    for wanted in (1, 3, 64):
        monkeypatch.setattr(reader, "WANTED", wanted)
        got = {r["path"]: r for r in source.listing(spark, str(root)).collect()}
        assert set(got) == want
    assert {r["path"] for r in source.listing(spark, f"file://{root}").collect()} == want
    assert got["_x/_y/_z.bin"]["size"] == 2 and got["_draft.md"]["mtime"] == int((root / "_draft.md").stat().st_mtime)
    read = {r["path"]: r["content"] for r in source.files(spark, str(root)).collect()}
    assert {p: bytes(c) for p, c in read.items()} == {p: (root / p).read_bytes() for p in want}
    listed = source.listing(spark, str(root)).unionByName(spark.createDataFrame([("not/there.md", 1, 1)], reader.SCHEMA))
    bad = source.contents(spark, str(root), listed).filter("reason is not null").collect()
    assert [(r["path"], r["content"], r["reason"]) for r in bad] == [("not/there.md", None, "can't be read: FileNotFoundError")]
    assert source.listing(spark, str(tmp_path / "none")).count() == 0


def test_unchanged_resources_stay_shut(spark, tmp_path):
    root = tmp_path / "v"
    write(root, NOTES | {"_draft.md": "[[concepts/memory]]\n"})
    v = engine.Vault(spark, str(root), f"file://{tmp_path}/i")
    report = v.project()
    assert (report["resources_opened"], report["indexed"]) == (2, 4)
    assert v.catalog.table("edges").filter("src_path = '_draft.md'").count() == 1
    hashes = lambda: {r["path"]: r["content_hash"] for r in v.catalog.table("resources").collect()}
    was, at = hashes(), os.stat(root / "files/data.txt")
    # other bytes of the same size and time: who opened the file would see them
    (root / "files/data.txt").write_text("9,9\n")
    os.utime(root / "files/data.txt", ns=(at.st_atime_ns, at.st_mtime_ns))
    assert v.project()["resources_opened"] == 0 and hashes() == was
    (root / "files/data.txt").write_text("9,9,9\n")
    assert v.project()["resources_opened"] == 1 and hashes()["files/data.txt"] != was["files/data.txt"] and hashes()["files/curve.png"] == was["files/curve.png"]


def test_embedding_in_slices(spark, tmp_path):
    root = tmp_path / "v"
    write(root, {f"n/{k}.md": f"# N\n\nText number {k}.\n" for k in range(20)})
    made = embedders.FakeEmbedder(4)
    v = engine.Vault(spark, str(root), f"file://{tmp_path}/i", made, buckets=4)
    v.project()
    done = []
    first = v.embed(slices=5, stop=lambda: len(done) == 2, progress=lambda n, of: done.append(v.catalog.table("embeddings").count()))
    assert first["cancelled"] and first["embedded"] == done[-1] < 20 and len(done) == 2
    assert v.status().first()["embedded"] == done[-1]

    class Counting(embedders.FakeEmbedder):
        def embed(self, texts):
            (tmp_path / f"seen-{os.getpid()}-{random.random()}").write_text("\n".join(t.replace("\n", " ") for t in texts))
            return super().embed(texts)

    v.embedder = Counting(4)
    rest = v.embed(slices=3)
    assert rest == {"embedded": 20 - done[-1], "cancelled": False}
    seen = [line for f in tmp_path.glob("seen-*") for line in f.read_text().splitlines()]
    assert len(seen) == len(set(seen)) == rest["embedded"]  # the others, each once
    full = engine.Vault(spark, str(root), f"file://{tmp_path}/full", made, buckets=4)
    full.reindex()
    assert dump(v) == dump(full)


def test_cancelled_by_its_tag(spark, tmp_path):
    root = tmp_path / "v"
    write(root, {f"n/{k}.md": f"# N\n\nText number {k}.\n" for k in range(6)})

    class Stops(embedders.FakeEmbedder):
        def embed(self, texts):
            import time

            (tmp_path / "began").touch()
            time.sleep(60)
            return super().embed(texts)

    import threading
    import time

    v = engine.Vault(spark, str(root), f"file://{tmp_path}/i", Stops(4), buckets=4)
    v.project()

    def cancel():
        while not (tmp_path / "began").exists():
            time.sleep(0.1)
        spark.sparkContext.cancelJobsWithTag("quill-embed")

    t = threading.Thread(target=cancel)
    t.start()
    assert v.embed(slices=2, tag="quill-embed") == {"embedded": 0, "cancelled": True}
    t.join()
    v.embedder = embedders.FakeEmbedder(4)
    assert v.embed()["embedded"] == 6 and ingest.status(v.catalog.table("chunks"), v.catalog.table("embeddings")).first()["embedded"] == 6
