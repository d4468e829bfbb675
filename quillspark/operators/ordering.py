"""Places in an order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.sources.store import stored


def positions(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """`rows` with `name`, from 0 by `order`: rows are sorted by ranges, and a range's rows come after those of all
    ranges before it. The last of `order` should tell equal rows apart, so that very many of them are cut
    into ranges too."""
    at = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")
    return at.withColumn("_part", part).join(starts, "_part").withColumn(name, place).drop("_at", "_part", "_before")


def numbered(rows: DataFrame, by: list[str], *order: Column, name: str = "n") -> DataFrame:
    """`rows` with `name`, from 0 within equal `by` (no nulls) by `order`; a key with very many rows is cut too."""
    at = stored(positions(rows, *map(F.asc, by), *order, name="_place"))
    first = at.groupBy(*by).agg(F.min("_place").alias("_first"))
    return at.join(first, by).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")
