"""Tables written in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset, under the warehouse, or, in a
    session on one machine alone, under a temporary folder, which the session then keeps."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
        top = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    top = top or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/quillspark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read back: lineage ends here, lost executors
    don't recompute what came before, and its size is known to the planner."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
