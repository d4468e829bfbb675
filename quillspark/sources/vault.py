"""A vault's folder: its files, its notes' contents, the inventory of all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import paths as p
from quillspark.sources import reader


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime): all files under `root` that no dot hides, by paths within it, listed in tasks. Names that start
    with an underscore, which Spark's own readers pass over, are there."""
    return reader.listing(spark, root)


def contents(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(path, content, size, mtime, reason) of the files in `listed`."""
    return reader.opened(spark, root, listed)


def files(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """(path, content, size, mtime) of all files under `root` that no dot hides, or of `only` those, read in parallel."""
    if only is not None and not only:
        return spark.createDataFrame([], schemas.FILES)
    listed = listing(spark, root)
    if only is not None:
        # a stated set of names that came from the driver
        listed = spark.createDataFrame([(x,) for x in only], "path string").select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"))
    return contents(spark, root, listed.filter(~p.hidden(F.col("path")))).filter("reason is null").drop("reason")


def is_note(path: str = "path"):
    return p.extension(F.col(path)) == "md"


def note_files(all_files: DataFrame) -> DataFrame:
    return all_files.filter(is_note())


def unread(listed: DataFrame, before: DataFrame | None) -> DataFrame:
    """The resources in `listed` whose content isn't known from `before`: not there, or of another size or time."""
    rows = listed.filter(~is_note())
    if before is None:
        return rows
    return rows.join(before.filter("content_hash is not null").select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def inventory(spark: SparkSession, root: str, listed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The resources table: every file but notes. A file of the same size and time as in `before` keeps its hash and
    isn't opened."""
    rows = reader.hashed(spark, root, unread(listed, before))
    if before is not None:
        rows = rows.unionByName(listed.filter(~is_note()).join(before.filter("content_hash is not null").select("path", "size", "mtime", "content_hash"), ["path", "size", "mtime"]))
    return rows.select("path", p.resource_class(F.col("path")).alias("class"), "size", "mtime", "content_hash")


def folders(listed: DataFrame) -> DataFrame:
    """(folder): every folder that holds a file, however deep, sorted."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return listed.filter(F.size(parts) > 1).select(F.explode(ups).alias("folder")).distinct().orderBy("folder")
