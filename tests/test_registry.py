"""Every registered query of the engine against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from quillspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The stemmed search is held against brute force in test_search.py.
ROWS_ONLY = {"note_chunks", "keyword_search_stemmed"}


def plain(row, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return tuple(cell(row[c]) for c in columns)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    rows = registry.queries()[name](spark, sf)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in ROWS_ONLY and rows.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(sql)
    columns = sorted(rows.columns)
    assert sorted(found.columns) == columns
    want = sorted(plain(dict(zip(found.columns, r, strict=True)), columns) for r in found.fetchall())
    assert sorted(plain(r.asDict(), columns) for r in rows.collect()) == want


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
