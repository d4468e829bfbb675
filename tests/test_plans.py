"""What queries on whole tables must not do on the way."""

from __future__ import annotations

from quillspark.operators import discover
from quillspark.plans import queries_search


def test_edge_bar_compares_linked_pairs_alone(spark, sf, monkeypatch):
    monkeypatch.setattr(discover, "best_pairs", None)
    assert {r["linked"] for r in queries_search.edge_bar(spark, sf).collect()} == {True, False}


def test_index_is_written_where_chunks_are_read(spark, sf, monkeypatch):
    seen, real = [], queries_search.stored
    monkeypatch.setattr(queries_search, "stored", lambda df: seen.append(df) or real(df))
    monkeypatch.setattr(queries_search, "_indexes", {})
    queries_search._index(spark, sf)
    assert len(seen) == 2 and all("Exchange" not in df._jdf.queryExecution().toString() for df in seen)
