"""A log that only grows, a folder for each run: what a run writes again replaces what it wrote before."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append(rows: DataFrame, root: str, run: str) -> None:
    """Adds a run's rows as lines of JSON. The same run once more, after a failure or in a replay, leaves its rows once."""
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"not a name of a run: {run!r}")
    rows.write.mode("overwrite").json(f"{root.rstrip('/')}/run={run}")


def follow(stream: DataFrame, root: str, name: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch of a stream as a run of its own: a batch that runs again isn't doubled."""
    writer = stream.writeStream.foreachBatch(lambda rows, n: append(rows, root, f"{name}-{n}")).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def entries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of all runs, with the run's name."""
    return spark.read.schema(schema + ", run string").option("basePath", root).json(f"{root.rstrip('/')}/run=*").withColumn("run", F.col("run"))
