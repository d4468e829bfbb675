"""Folder and index change together; logs that only grow; embedding alone and in slices."""

from __future__ import annotations

import json

import numpy as np
import pytest
from test_vault import NOTES, dump, write

from quillspark.functions import embedders
from quillspark.plans import engine
from quillspark.sources import edits, runlog


def files(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_a_failed_projection_leaves_the_old_folder(spark, tmp_path, monkeypatch):
    root = tmp_path / "v"
    write(root, NOTES)
    v = engine.Vault(spark, str(root), f"file://{tmp_path}/i", buckets=4)
    v.project()
    before, index = files(root), dump(v)

    def fails(*_, **__):
        raise RuntimeError("no room")

    monkeypatch.setattr(v.catalog, "commit", fails)
    for change in (lambda: v.add("notes/new.md", "x"), lambda: v.write_body("notes/other", "y"), lambda: v.move("concepts/memory.md", "ideas/recall.md"), lambda: v.move("notes", "deep/down", folder=True), lambda: v.delete("files", folder=True)):
        with pytest.raises(RuntimeError, match="no room"):
            change()
        assert files(root) == before
    monkeypatch.undo()
    assert dump(v) == index and not list(root.glob(".changes-*"))
    moved = v.move("files", "data", folder=True)
    assert (moved["moved_notes"], moved["moved_resources"], moved["moved"]) == (0, 2, 2)
    write(root, {"data/readme.md": "one\n"})
    v.project()
    gone = v.delete("data", folder=True)
    assert (gone["deleted_notes"], gone["deleted_resources"], gone["deleted"]) == (1, 2, 3)


class Died(BaseException):
    """Not an Exception: nothing cleans up after it."""


def test_what_a_dead_process_left(spark, tmp_path):
    root, index = tmp_path / "v", tmp_path / "i"
    write(root, NOTES)
    before = files(root)
    new = spark.createDataFrame([("deep/memory.md", b"new"), ("notes/other.md", b"newer")], "path string, content binary")

    def left(mark):
        """The folder of a change as a process leaves it that dies between the renames and the end."""
        stage = root / ".changes-dead"
        stage.mkdir()
        (stage / "new-0").write_bytes(b"new")
        steps = [["concepts", "deep"], ["deep/memory.md", ".changes-dead/old-0"], [".changes-dead/new-0", "deep/memory.md"], ["files/data.txt", ".changes-dead/gone-0"]]
        (stage / "intent.json").write_text(json.dumps({"steps": steps, "mark": mark}))
        for a, b in steps:
            (root / b).parent.mkdir(parents=True, exist_ok=True)
            (root / a).rename(root / b)

    left(0)
    engine.Vault(spark, str(root), f"file://{index}")  # the next open; the index has no number over 0
    assert files(root) == before
    left(0)
    assert edits.recover(spark, str(root), 1) == {"finished": 1, "undone": 0}
    after = files(root)
    assert after["deep/memory.md"] == b"new" and "files/data.txt" not in after and not any(".changes" in p for p in after)
    (root / ".changes-early").mkdir()
    (root / ".changes-early/new-0").write_bytes(b"?")
    assert edits.recover(spark, str(root), 1) == {"finished": 0, "undone": 0} and files(root) == after
    assert edits.apply(spark, str(root), new, mark=3) == ["deep/memory.md", "notes/other.md"]
    assert files(root)["notes/other.md"] == b"newer"


def test_two_runs_and_a_replay(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    rows = lambda n: spark.range(n).selectExpr("concat('m', id % 2) AS model", "id AS chunks")
    runlog.append(rows(5), root, "2026-01-01.a")
    runlog.append(rows(3), root, "b")
    runlog.append(rows(3), root, "b")
    got = runlog.entries(spark, root, "model string, chunks long").groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in got} == {"2026-01-01.a": 5, "b": 3}
    with pytest.raises(ValueError):
        runlog.append(rows(1), root, "../x")
    rows(4).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("model string, chunks long").parquet(f"file://{tmp_path}/in")
    for checkpoint in ("c1", "c2"):  # the second starts anew, so its batch 0 runs once more
        assert runlog.follow(stream, f"{root}2", "s", f"file://{tmp_path}/{checkpoint}").awaitTermination(120) is not False
    assert runlog.entries(spark, f"{root}2", "model string, chunks long").count() == 4


def test_slices_that_differ_are_seen(spark):
    class Leaky(embedders.FakeEmbedder):
        def embed(self, texts):
            return super().embed(texts) + np.float32(0.25 * (len(texts) > 1) * np.array([[t.startswith("b")] for t in texts]))

    texts = spark.createDataFrame([(str(n), f"{'ab'[n % 2]} {n}") for n in range(40)], "text_hash string, text string").coalesce(1)
    got = {int(r["text_hash"]): r["largest"] for r in embedders.slices_agree(texts, Leaky(4)).collect()}
    assert all(got[n] == (0 if n % 2 == 0 else pytest.approx(0.25, abs=1e-6)) for n in range(40))
    assert embedders.slices_agree(texts.limit(0), Leaky(4)).collect() == []
