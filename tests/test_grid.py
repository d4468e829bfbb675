"""Notes that meet in the cells of a grid against plain loops."""

from __future__ import annotations

import random
from functools import reduce

import pytest

from quillspark.functions import kernels
from quillspark.operators import discover, metrics


def vectors(n=60, seed=7, dim=5):
    r = random.Random(seed)
    return [(f"v/{k}", s, [round(r.gauss(0, 1), 1) for _ in range(dim)]) for k in range(n) for s in range(1 + k % 4)]


def d2(v, w):
    """Added from left to right; sum() compensates."""
    return reduce(lambda s, d: s + d * d, (x - y for x, y in zip(v, w, strict=True)), 0.0)


def best(rows):
    """{(anchor, path): (d2, seq)} of all notes but each itself."""
    found = {}
    for a, _, v in rows:
        for b, s, w in rows:
            if a != b:
                found[a, b] = min(found.get((a, b), (float("inf"), 0)), (d2(v, w), s))
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, "note_path string, seq int, vector array<double>").repartition(3)


@pytest.fixture(params=[(1 << 14, 1 << 16, 1 << 21), (20, 30, 1 << 21), (20, 30, 40)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(discover, "HELD", request.param[0])
    monkeypatch.setattr(discover, "PASSING", request.param[1])
    return request.param


def test_heads_of_all_lists(spark, sizes):
    """The first k, ties and copies included, and all up to a bar; no more than that leaves a cell."""
    rows = vectors() + [(f"v/copy{k}", 0, [1.0, 0.5, 0.0, 0.0, 0.5]) for k in range(12)]
    want = {}
    for (a, b), (d, _) in best(rows).items():
        want.setdefault(a, []).append((d, b))
    for k in (1, 7):
        got = {}
        for r in discover.nearest_notes(frame(spark, rows), k).orderBy("rank").collect():
            got.setdefault(r["anchor"], []).append((r["d2"], r["path"]))
        assert got.keys() == want.keys()
        assert all([p for _, p in got[a]] == [p for _, p in sorted(want[a])[:k]] for a in want)
    near = {(r["anchor"], r["path"], r["rank"]) for r in discover.nearest_notes(frame(spark, rows), bar=1.5).collect()}
    assert near == {(a, p, n) for a, own in want.items() for n, (d, p) in enumerate(sorted(own)) if d <= 1.5} and near


@pytest.mark.parametrize("pairs", [1 << 21, 50])
@pytest.mark.parametrize("scale", [1.0, 1e20, 1e-20])
def test_cells_of_any_size_and_scale(spark, monkeypatch, pairs, scale):
    """Pieces that cut notes, and numbers that single precision can't hold."""
    rows = [(p, s, [x * scale for x in v]) for p, s, v in vectors(40)]
    want, left = {}, [(p, s, v) for p, s, v in sorted(rows)]
    for (a, b), (d, s) in best(rows).items():
        want.setdefault(a, []).append((d, b, s))
    monkeypatch.setattr(kernels, "PAIRS", pairs)
    import pyarrow as pa

    def table(side, some):
        return pa.table({"cell": pa.array([0] * len(some), pa.int32()), "side": pa.array([side] * len(some), pa.int32()), "note_path": [x[0] for x in some], "seq": pa.array([x[1] for x in some], pa.int32()), "vector": pa.array([x[2] for x in some], pa.list_(pa.float64())), "other": pa.array([x[3] if len(x) > 3 else None for x in some], pa.string())})

    tied = sorted((p, 0, None, p) for p in {x[0] for x in rows})
    batches = pa.concat_tables([table(0, left), table(1, tied), table(2, left)]).to_batches(max_chunksize=33)
    got = {}
    for out in kernels.crossed(6)(iter(batches)):
        for r in out.to_pylist():
            got.setdefault(r["anchor"], []).append((r["d2"], r["path"], r["seq"]))
    assert {a: sorted(v) for a, v in got.items()} == {a: sorted(v)[:6] for a, v in want.items()}


def test_many_anchors_as_few(spark, monkeypatch, sizes):
    """The grid gives what the blocks of anchors give, links left out; pairs alone too."""
    rows = vectors(50, 9)
    df, pairs = frame(spark, rows), [(f"v/{n}", f"v/{3 * n % 50}") for n in range(1, 50)]
    linked = spark.createDataFrame(pairs, "a string, b string")
    anchors, middle = df.selectExpr("note_path AS anchor").distinct(), discover.centroids(df)
    key = lambda x: (x["anchor"], x["rank"], x["path"], x["seq"], round(x["d2"], 12), x["band"], round(x["z"], 9))
    monkeypatch.setattr(discover, "shortlist_size", lambda limit: 20)
    blocks = sorted(map(key, discover.similar(df, middle, linked, anchors, 6).collect()))
    monkeypatch.setattr(discover, "ANCHORS", 0)
    monkeypatch.setattr(discover, "blocks", None)  # no anchor goes by the driver
    assert sorted(map(key, discover.similar(df, middle, linked, anchors, 6).collect())) == blocks and len(blocks) == 300
    want = best(rows)
    got = {(r["anchor"], r["path"]): (r["d2"], r["seq"]) for r in discover.pair_distances(df, linked.selectExpr("a AS anchor", "b AS note_path")).collect()}
    assert got.keys() == {p for p in pairs if p[0] != p[1]} | {p for p in pairs if p[0] == p[1]}
    assert all(got[p] == (pytest.approx(want[p][0], abs=1e-12), want[p][1]) for p in pairs if p[0] != p[1])


def test_mutual_of_heads(spark):
    near = spark.createDataFrame([("a", "b", 0), ("b", "a", 9), ("c", "a", 0)], "anchor string, path string, rank int")
    assert [tuple(r) for r in metrics.mutual(near, 10).collect()] == [("a", "b")]
