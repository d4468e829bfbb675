from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import ordering


def test_positions_and_numbers(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 40) AS k", "id * 37 % 101 AS v")
    got = ordering.positions(rows, F.desc("v"), F.asc("id")).collect()
    assert [r["position"] for r in sorted(got, key=lambda r: (-r["v"], r["id"]))] == list(range(3000))
    seen = {}
    for r in sorted(ordering.numbered(rows, ["k"], F.asc("v"), F.asc("id")).collect(), key=lambda r: (r["k"], r["v"], r["id"])):
        assert r["n"] == seen.get(r["k"], 0)
        seen[r["k"]] = r["n"] + 1
    assert ordering.positions(rows.limit(0), F.asc("id")).count() == 0
