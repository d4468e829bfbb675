"""A folder's changes as a stream: deletes and renames too, the same batch when it runs again."""

from __future__ import annotations

import os
import random

from test_vault import NOTES, dump, write

from quillspark.functions import embedders
from quillspark.operators import changes
from quillspark.plans import engine
from quillspark.streaming import folder, watch


def test_between_against_dictionaries(spark):
    draw = random.Random(4)
    before = {f"a{n}": draw.choice("xyz") + str(draw.randrange(12)) for n in range(300)}
    after = {(f"b{n}" if draw.random() < 0.3 else f"a{n}"): (h if draw.random() < 0.8 else "new") for n, h in enumerate(before.values()) if draw.random() < 0.8}
    before |= {f"hot/{n:03}": "same" for n in range(150)}
    after |= {f"hot2/{n:03}": "same" for n in range(120)} | {"null": None}
    got = {tuple(r) for r in changes.between(*(spark.createDataFrame(list(s.items()), "path string, hash string") for s in (before, after))).collect()}
    want = {(p, None, "changed", after[p]) for p in before if p in after and after[p] != before[p]}
    gone, came = sorted(set(before) - set(after)), sorted(set(after) - set(before))
    for h in {before[p] for p in gone} | {after[p] for p in came}:
        old, new = [p for p in gone if before[p] == h], [p for p in came if after[p] == h]
        pairs = list(zip(old, new, strict=False)) if h is not None else []
        want |= {(b, a, "renamed", h) for a, b in pairs}
        want |= {(p, None, "deleted", h) for p in old[len(pairs) :]} | {(p, None, "created", h) for p in new[len(pairs) :]}
    assert got == want
    assert changes.between(*(spark.createDataFrame([], "path string, hash string") for _ in range(2))).count() == 0


def test_snapshots_and_shards(tmp_path):
    root = tmp_path / "v"
    write(root, NOTES)
    own = folder.Snapshots(str(root), str(tmp_path / "state"), 3)
    source = folder._Changes({"path": str(root), "state": str(tmp_path / "state"), "shards": "3"})
    batch = lambda a, b: sorted(r[:2] for p in source.partitions({"snapshot": a}, {"snapshot": b}) for r in source.read(p))
    assert own.last() == (0, []) and source.initialOffset() == {"snapshot": 0}
    assert source.latestOffset() == source.latestOffset() == {"snapshot": 1}
    seen = sorted(p for p in NOTES if not p.startswith("."))
    assert batch(0, 1) == [(p, "created") for p in seen] and source.partitions({"snapshot": 1}, {"snapshot": 1}) == []
    (root / "files/data.txt").rename(root / "_data.txt")
    write(root, {"notes/other.md": "longer than it was, by some words and a [[link]]\n"})
    (root / "concepts/memory.md").unlink()
    assert source.latestOffset() == {"snapshot": 2}
    want = [("_data.txt", "created"), ("concepts/memory.md", "deleted"), ("files/data.txt", "deleted"), ("notes/other.md", "changed")]
    first = [r for p in source.partitions({"snapshot": 1}, {"snapshot": 2}) for r in source.read(p)]
    assert batch(1, 2) == want
    (root / "_data.txt").unlink()  # a batch that runs again doesn't see what came later
    again = [r for p in source.partitions({"snapshot": 1}, {"snapshot": 2}) for r in source.read(p)]
    assert again == first and all(r[2] for r in again)
    source.commit({"snapshot": 2})
    assert not list((tmp_path / "state").glob("*-00000001*")) and own.last()[0] == 2
    assert source.latestOffset() == {"snapshot": 3} and batch(2, 3) == [("_data.txt", "deleted")]


def test_deletes_and_renames_reconcile(spark, tmp_path):
    root = tmp_path / "v"
    write(root, NOTES)
    v = engine.Vault(spark, str(root), f"file://{tmp_path}/i", embedders.FakeEmbedder(4), buckets=4)
    reports = []

    def run(checkpoint="cp"):
        q = watch.follow(v, f"file://{tmp_path}/state", f"file://{tmp_path}/{checkpoint}", once=True, shards=2, told=reports.append)
        assert q.awaitTermination(180)

    run()
    assert reports[-1]["created"] == 5 and reports[-1]["whole"] and v.status().first()["embedded"] == 3
    (root / "notes/other.md").unlink()
    (root / "files/data.txt").rename(root / "files/figures.txt")
    run()
    assert [reports[-1][k] for k in ("created", "changed", "deleted", "renamed")] == [0, 0, 1, 1]
    assert {r["path"] for r in v.list_notes().collect()} == {"concepts/memory.md", "notes/repetition.md"}
    assert {r["path"] for r in v.list_resources().collect()} == {"files/curve.png", "files/figures.txt"}
    # a note that only changed: its own buckets
    write(root, {"concepts/memory.md": "# Memory\n\nAnew, with [[notes/repetition]] in it.\n"})
    run()
    assert not reports[-1]["whole"] and reports[-1]["changed"] == 1
    full = engine.Vault(spark, str(root), f"file://{tmp_path}/full", embedders.FakeEmbedder(4), buckets=4)
    full.reindex()
    was = dump(v)
    assert {k: x for k, x in was.items() if k != "embeddings"} == {k: x for k, x in dump(full).items() if k != "embeddings"}
    # the last batch once more, as after a failure before it was noted as done
    n = len(reports)
    commits = sorted((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(commits[-1])
    for crc in (tmp_path / "cp/commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    run()
    assert len(reports) == n + 1 and reports[-1]["changed"] == 1 and dump(v) == was
