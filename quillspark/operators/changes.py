"""What changed between two states of a set of files, with files that only moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ordering import numbered

#: path is null in no row; old_path is where a renamed file was.
SCHEMA = "path string, old_path string, change string, hash string"


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, hash) of two states (path, hash): created, changed or deleted, with the hash the file has
    now, or had. Files that are as they were aren't there. Paths are unique in each state."""
    old, new = before.select("path", F.col("hash").alias("was")), after.select("path", F.col("hash").alias("is"))
    both = old.withColumn("there", F.lit(True)).join(new.withColumn("here", F.lit(True)), "path", "full_outer")
    change = F.when(F.col("there").isNull(), "created").when(F.col("here").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select("path", change.alias("change"), F.coalesce("is", "was").alias("hash")).filter("change is not null")


def renamed(changes: DataFrame) -> DataFrame:
    """`changes` (path, change, hash) with old_path: a file that went and one that came with the same content are one
    that was renamed. Of several with one content the first by path goes with the first, and so on; what is left
    over stays created or deleted. A null hash is no content. One content may have any number of files."""
    moves = changes.filter("change in ('created', 'deleted') and hash is not null")
    each = numbered(moves.select("path", "change", "hash"), ["hash", "change"], F.asc("path"), name="nth")
    gone, came = (each.filter(F.col("change") == c).select("hash", "nth", F.col("path").alias(name)) for c, name in (("deleted", "old_path"), ("created", "path")))
    pairs = gone.join(came, ["hash", "nth"]).select("path", "old_path")
    rest = changes.join(pairs.select(F.col("path").alias("path"), F.lit("created").alias("change")).union(pairs.select("old_path", F.lit("deleted"))), ["path", "change"], "left_anti")
    moved = pairs.join(changes.filter("change = 'created'").select("path", "hash"), "path").select("path", "old_path", F.lit("renamed").alias("change"), "hash")
    return rest.select("path", F.lit(None).cast("string").alias("old_path"), "change", "hash").unionByName(moved)


def between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, old_path, change, hash) from one state (path, hash) to the next: created, changed, deleted or renamed."""
    return renamed(compared(before, after))
