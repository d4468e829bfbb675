"""Block kernels against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.functions import kernels
from quillspark.operators import discover


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=False) if x is not None and y is not None)


@pytest.mark.parametrize("ragged", [False, True])
@pytest.mark.parametrize("pairs", [1 << 21, 7])
def test_closest(monkeypatch, ragged, pairs):
    monkeypatch.setattr(kernels, "PAIRS", pairs)
    draw = random.Random(2)
    vec = lambda: [round(draw.uniform(-1, 1), 1) for _ in range(draw.randint(2, 4) if ragged else 3)]
    rows = [(f"n{n:02}", k, vec(), draw.choice([None, [], [0, 2], [1, 2, 5], [0, 1, 2, 3]])) for n in range(12) for k in range(draw.randint(1, 5))]
    asked = [(no, vec()) for no in (2, 0, 0, 1, 2, 3, 2)]
    kernel = kernels.closest(np.array([n for n, _ in asked], np.int32), kernels.matrix([v for _, v in asked]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["note_path", "seq", "vector", "wanted"])
    for names in (["note_path", "seq", "vector", "wanted"], ["note_path", "seq", "vector"]):
        got = {}
        for out in kernel(iter([batch.select(names)])):
            for r in out.to_pylist():
                key = r["no"], r["note_path"]
                got[key] = min(got.get(key, (9e9, 0)), (r["d2"], r["seq"]))
        want = {}
        for path, seq, v, wanted in rows:
            for no, q in asked:
                if "wanted" not in names or no in (wanted or []):
                    want[no, path] = min(want.get((no, path), (9e9, 0)), (d2(v, q), seq))
        assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0], abs=1e-12) and got[k][1] == want[k][1] for k in want)
    assert list(kernels.closest(np.zeros(0, np.int32), np.zeros((0, 3)))(iter([batch]))) == []


def test_nearby_skips():
    draw = random.Random(3)
    rows = [(f"n{n:03}", [draw.uniform(-1, 1) for _ in range(4)], draw.choice([None, [0], [1, 2], [0, 1, 2]])) for n in range(200)]
    asked = [[draw.uniform(-1, 1) for _ in range(4)] for _ in range(3)]
    kernel = kernels.nearby(pa.array(["a", "b", "c"]), np.array(asked), 5)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["note_path", "seq", "vector", "skip"])
    got = {}
    for out in kernel(iter([batch.slice(0, 90), batch.slice(90)])):
        for r in out.to_pylist():
            got.setdefault(r["query_id"], []).append(r["note_path"])
    for n, q in enumerate("abc"):
        want = sorted((d2(v, asked[n]), p) for p, v, skip in rows if n not in (skip or []))[:5]
        assert sorted(got[q]) == sorted(p for _, p in want)


def test_similar_in_blocks(spark, monkeypatch):
    """Many blocks of anchors and of their chunks give what one gives; the population's z holds when it is worked out again."""
    draw = random.Random(5)
    rows = [(f"v/{n}", k, [draw.gauss(0, 1) for _ in range(6)]) for n in range(40) for k in range(1 + n % 4)]
    g = spark.createDataFrame(rows, "note_path string, seq int, vector array<double>")
    linked = spark.createDataFrame([(f"v/{n}", f"v/{3 * n % 40}") for n in range(40)], "a string, b string")
    anchors = g.selectExpr("note_path AS anchor").distinct()
    middle = discover.centroids(g)
    whole = sorted(map(str, discover.similar(g, middle, linked, anchors, 5).collect()))
    monkeypatch.setattr(discover, "CHUNKS", 9)
    monkeypatch.setattr(discover, "blocks", lambda rows, key: (rows.filter(f"pmod(xxhash64({key}), 3) = {n}") for n in range(3)))
    assert sorted(map(str, discover.similar(g, middle, linked, anchors, 5).collect())) == whole and len(whole) == 200
    dumped = discover.scored(g, middle, linked, anchors, 5).persist()
    tied = {frozenset((f"v/{n}", f"v/{3 * n % 40}")) for n in range(40)}
    assert all(frozenset((r["anchor"], r["path"])) not in tied and r["anchor"] != r["path"] for r in dumped.collect())
    assert all(r["largest"] < 1e-9 for r in discover.recheck(dumped).collect())
    near = {(r["anchor"], r["path"]): r["d2"] for r in discover.best_pairs(g, anchors).collect()}
    assert len(near) == 40 * 39
    for r in dumped.collect():
        want = min(d2(a[2], b[2]) for a in rows if a[0] == r["anchor"] for b in rows if b[0] == r["path"])
        assert r["d2"] == pytest.approx(want, abs=1e-12) == near[r["anchor"], r["path"]]
