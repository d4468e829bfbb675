from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import mixing


def reshared(sizes: dict, weights=(5, 2, 1), most=3.0) -> dict:
    """Targets by resharing, round for round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, free = {}, set(order)
    while free:
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}
        free -= over
    return fixed


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 5)), min_size=1, max_size=8), st.integers(0, 300))
@settings(max_examples=150, deadline=None)
def test_fit_is_as_good_as_all_subsets(rows, budget):
    by = {}
    for length, count in rows:
        by[length] = by.get(length, 0) + count
    lengths, counts = np.array(sorted(by)), np.array([by[k] for k in sorted(by)])
    taken = mixing.fit(lengths, counts, budget)
    assert ((0 <= taken) & (taken <= counts)).all()
    reach = {0}
    for length, count in by.items():
        reach = {r + k * length for r in reach for k in range(count + 1)}
    assert abs(int((taken * lengths).sum()) - budget) == min(abs(r - budget) for r in reach)


def test_fit_of_many_documents_is_exact():
    r = np.random.default_rng(1)
    lengths, counts = np.arange(1, 5000), r.integers(1, 90, 4999)
    for share in (0.1, 0.5, 0.93):
        budget = int((lengths * counts).sum() * share)
        assert int((mixing.fit(lengths, counts, budget) * lengths).sum()) == budget


def test_mix_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, by = {}, {}
    for r in docs.select("doc_id", "source", "text").collect():
        sizes[r["doc_id"]] = (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
        by[r["source"]] = by.get(r["source"], 0) + sizes[r["doc_id"]][1]
    want, rows = reshared(by), mixing.mix(docs).collect()
    assert len(rows) == len(sizes)
    for r in rows:
        assert (r["source"], r["size"]) == sizes[r["doc_id"]]
        assert r["source_size"] == by[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    for s, goal in want.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - goal) <= max(2, 0.01 * goal)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_hot_length_takes_its_count(spark):
    """A length that very many documents have is dealt over salts."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'a b c' AS text", "'s' AS source").union(spark.range(20_000, 20_400).selectExpr("id AS doc_id", "repeat('w ', id % 50) AS text", "if(id % 2 = 0, 'r', null) AS source"))
    found = mixing.mix(rows).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for source, taken, target in found:
        assert abs(taken - target) <= 3, (source, taken, target)


def test_targets_match_resharing(spark):
    r = random.Random(5)
    for _ in range(3):
        sizes = {None if k == 0 else f"s{k}": r.choice([0, 1, 10, 1000, 50_000]) for k in range(7)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        want = reshared(sizes)
        for s, _, target in mixing.targets(rows).collect():
            assert abs(target - want[s]) < 1e-6 * (1 + target)


def test_mixed_repeats_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (2, "c", "y"), (3, None, None)], "doc_id long, text string, source string")
    taken = {r["doc_id"]: 0 for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["copies"]
    got = {}
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in taken.items() if v}


def test_fit_beyond_the_window():
    """Long documents alone come as near to the budget as any subset does."""
    assert mixing.fit(np.array([49_000, 51_000, 60_000]), np.ones(3), 100_000).tolist() == [1, 1, 0]
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(r.integers(3 * mixing.WINDOW, 12 * mixing.WINDOW, 9))
        counts = r.integers(1, 3, len(lengths))
        budget = int((lengths * counts).sum() * r.uniform(0.2, 0.9))
        reach = {0}
        for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {x + k * length for x in reach for k in range(count + 1)}
        taken = mixing.fit(lengths, counts, budget)
        assert ((0 <= taken) & (taken <= counts)).all()
        assert abs(int((taken * lengths).sum()) - budget) == min(abs(x - budget) for x in reach)


def test_fit_of_many_long_documents(monkeypatch):
    """In units of several words the long documents come near, and the short ones fit the rest exactly."""
    monkeypatch.setattr(mixing, "BITS", 1 << 24)
    r = np.random.default_rng(5)
    long = np.unique(r.integers(3 * mixing.WINDOW, 12 * mixing.WINDOW, 60))
    budget = int(long.sum() * 0.4)
    assert abs(int((mixing.fit(long, np.ones(len(long)), budget) * long).sum()) - budget) <= 1e-4 * budget
    # 60,000 and all short ones are too few, 51,000 + 49,000 and some of them are as wished for
    lengths, counts = np.array([7, 11, 490_000, 510_000, 600_000]), np.array([500, 500, 1, 1, 1])
    assert int((mixing.fit(lengths, counts, 1_004_000) * lengths).sum()) == 1_004_000


def test_fit_of_long_documents():
    """Few very long documents: the nearest sum, at lengths up to a million."""
    r = np.random.default_rng(2)
    assert int((mixing.fit(np.array([40000]), np.array([1]), 30000) * 40000).sum()) == 40000
    assert int((mixing.fit(np.array([40000, 50000]), np.array([3, 2]), 100000) * np.array([40000, 50000])).sum()) == 100000
    for top in (10_000, 100_000, 1_000_000):
        for _ in range(6):
            lengths = np.unique(r.integers(top // 10, top, 9))
            counts = np.ones_like(lengths)
            reach = {0}
            for n in lengths.tolist():
                reach |= {x + n for x in reach}
            budget = int(lengths.sum() * r.uniform(0.2, 0.8))
            near = min(abs(x - budget) for x in reach)
            assert abs(int((mixing.fit(lengths, counts, budget) * lengths).sum()) - budget) <= near + 2 * len(lengths) * -(-top // 50_000)


def test_a_long_plan_meets_its_rows_in_many_places(spark):
    rows = spark.createDataFrame([(n % 3 and "s" or None, n % 5, n * 7919) for n in range(400)], "source string, size long, draw long")
    plan = spark.createDataFrame([(s, z, f"{s}{z}") for s in ("s", None) for z in range(5)], "s string, z long, name string")
    few, many = mixing._with_plan(rows, plan, 10), mixing._with_plan(rows, plan, 10, most=2)
    assert few.count() == 400 and sorted(map(str, few.collect())) == sorted(map(str, many.select(few.columns).collect()))
