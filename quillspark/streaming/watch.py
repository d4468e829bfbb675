"""Following a vault: bursts of changes, and a projection for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.paths import hidden
from quillspark.sources.store import stored
from quillspark.streaming import folder


def relevant(changes: DataFrame, path: str = "path") -> DataFrame:
    """Changes of files that no dot hides."""
    return changes.filter(~hidden(F.col(path)))


def bursts(changes: DataFrame, ts: str = "ts", quiet: str = "300 milliseconds", late: str = "10 seconds", by: list[str] | None = None) -> DataFrame:
    """(by, started, ended, changes): one row per burst, which ends after so much quiet. On a stream a
    burst comes out once the watermark, `late` behind the newest change, has passed its end."""
    if changes.isStreaming:
        changes = changes.withWatermark(ts, late)
    if not by:  # a stream's sessions need a key
        changes = changes.withColumn("_all", F.lit(0))
    own = changes.groupBy(*(by or ["_all"]), F.session_window(ts, quiet)).agg(F.count("*").alias("changes"))
    return own.select(*(by or []), F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "changes")


def follow(vault, state: str, checkpoint: str, every: str = "300 milliseconds", once: bool = False, shards: int = 16, told: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Keeps the index of a Vault as its folder is: each batch of created, changed, deleted and renamed files is reconciled, and
    `told` hears the report. `state` is the folder of the stream's snapshots. A batch that runs again changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        own = stored(rows)
        if not own.isEmpty():
            report = vault.reconcile(own)
            if told is not None:
                told(report)

    writer = folder.changes(vault.spark, vault.root, state, shards).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def changed_files(spark, root: str, every: str = "1 second") -> DataFrame:
    """A stream of new or newer notes under `root`: (path, modified)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return relevant(read.select("path", F.col("modificationTime").alias("modified")))


def reconcile(changes: DataFrame, project: Callable[[], object], embed: Callable[[], object] | None, checkpoint: str, every: str = "300 milliseconds", once: bool = False) -> StreamingQuery:
    """Projects the vault, and embeds what has no vector, after each batch of changes that has any. State
    is in the tables alone: a batch that runs again finds nothing left to do."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            project()
            if embed is not None:
                embed()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
