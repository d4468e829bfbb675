"""Views of hits: chunks' texts stay where they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search


@pytest.mark.parametrize("view", ["notes", "passages"])
def test_texts_stay_where_they_are(spark, view):
    """Hits go to the chunks, not the chunks' texts to the hits."""
    hits = spark.createDataFrame([(1, "n1", 3, 0.5, 0, None, None, None, 0), (1, "gone", 0, 0.4, 1, None, None, None, 1), (1, "n1", 4, 0.3, 2, None, None, None, 2), (1, "same", 4, 0.2, 2, None, None, None, 3)], "query_id long, note_path string, seq int, score double, bm25_rank int, vector_rank int, cos double, best_cos double, rank int")
    lines = spark.createDataFrame([(p, k, "alpha r1 r2") for p in ("n1", "n2", "same") for k in range(9)], "note_path string, seq int, text string").cache()
    lines = lines.withColumn("heading_path", F.lit(None).cast("string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with hits whose size the planner doesn't know
    try:
        found = search.passage_view(hits, lines, 2) if view == "passages" else search.note_view(hits, lines, spark.createDataFrame([(1, "alpha")], "query_id long, query string"), 2)
        how = found._jdf.queryExecution().executedPlan().toString()
        rows = [(r["path"], r["rank"]) for r in found.orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [note_path" in how and "hashpartitioning(note_path" not in how.split("InMemoryTableScan")[0]
    assert rows == ([("n1", 0), ("n1", 1)] if view == "passages" else [("n1", 0), ("same", 1)])
