"""A folder of files as a data source: folders are listed in tasks, and files are opened in tasks where they are asked for.

Spark's own file reader passes over names that start with an underscore and opens whatever it lists; here
both are the caller's choice. Files are reached through pyarrow, which knows local folders and the usual stores.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, mtime long"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])
#: Folders that the driver lists until there are so many to hand out, rows of a batch, bytes read at once.
WANTED, ROWS, BYTES = 64, 8192, 1 << 20
#: Bytes of content that a batch has at most, unless it has one file.
HELD = 1 << 24


def store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of `root` and its path there."""
    if "://" in root:
        found, path = fs.FileSystem.from_uri(root)
        return found, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:")).rstrip("/")


def children(files: fs.FileSystem, top: str, folder: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(folders, files as (path, size, mtime)) right in `folder`, a path within `top`, that no dot hides. A local link to a folder isn't followed."""
    deeper, own = [], []
    at = f"{top}/{folder}" if folder else top
    for info in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        name = info.base_name
        path = f"{folder}/{name}" if folder else name
        if name.startswith("."):
            continue
        if info.type == fs.FileType.Directory:
            if not (isinstance(files, fs.LocalFileSystem) and os.path.islink(info.path)):
                deeper.append(path)
        elif info.type == fs.FileType.File:
            own.append((path, info.size, (info.mtime_ns or 0) // 1_000_000_000))
    return deeper, own


def walk(files: fs.FileSystem, top: str, folder: str) -> Iterator[list[tuple[str, int, int]]]:
    """The files of `folder` and of all below it, a list for each folder."""
    todo = [folder]
    while todo:
        deeper, own = children(files, top, todo.pop())
        todo += deeper
        yield own


@dataclass
class Folder(InputPartition):
    """A folder's own files, or with `deep` those of all below it too."""

    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class _Listing(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        """A partition for each folder of the upper levels, and one for each folder with all below it where there are
        enough to hand out."""
        files, top = store(self.root)
        done, level = [], [""]
        while level and len(level) < WANTED:
            done += [Folder(x, False) for x in level]
            level = [x for folder in level for x in children(files, top, folder)[0]]
        return [*done, *(Folder(x, True) for x in level)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, top = store(self.root)
        for rows in walk(files, top, partition.path) if partition.deep else [children(files, top, partition.path)[1]]:
            for k in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows[k : k + ROWS]], _ARROW)


class FolderFiles(DataSource):
    """spark.read.format("quillspark_files").load(root): (path, size, mtime) of all files below `root` that no dot hides."""

    @classmethod
    def name(cls) -> str:
        return "quillspark_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options["path"])


def _spread(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The rows dealt out by path, so that a folder with most of the files is read by many tasks. The number is given, as
    paths are small and their partitions would else be put together."""
    return listed.repartition(4 * spark.sparkContext.defaultParallelism, "path")


def opened(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(path, content, size, mtime, reason) of the files that `listed` (path, size, mtime) names, each opened once; one that can't be
    read has a reason in place of content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(root)
        for batch in batches:
            cells: list[tuple[bytes | None, str | None]] = []
            size, first = 0, 0
            for path in batch.column("path").to_pylist():
                try:
                    with files.open_input_file(f"{top}/{path}") as f:
                        cells.append((f.read(), None))
                except OSError as e:
                    cells.append((None, f"can't be read: {type(e).__name__}"))
                size += len(cells[-1][0] or b"")
                if size >= HELD:
                    yield out(batch, first, cells)
                    first, cells, size = first + len(cells), [], 0
            if cells:
                yield out(batch, first, cells)

    def out(batch: pa.RecordBatch, first: int, cells: list) -> pa.RecordBatch:
        own = batch.slice(first, len(cells))
        return pa.RecordBatch.from_arrays([own.column("path"), pa.array([c for c, _ in cells], pa.binary()), own.column("size"), own.column("mtime"), pa.array([r for _, r in cells], pa.string())], ["path", "content", "size", "mtime", "reason"])

    return _spread(spark, listed.select("path", "size", "mtime")).mapInArrow(run, "path string, content binary, size long, mtime long, reason string")


def digest(files: fs.FileSystem, path: str) -> str | None:
    """The SHA-256 of a file, read piece by piece; None where it can't be read."""
    own = hashlib.sha256()
    try:
        with files.open_input_stream(path) as f:
            while piece := f.read(BYTES):
                own.update(piece)
    except OSError:
        return None
    return own.hexdigest()


def hashed(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """(path, size, mtime, content_hash) of the files that `listed` names; contents stay in the task that reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(root)
        for batch in batches:
            own = pa.array([digest(files, f"{top}/{p}") for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "content_hash"])

    return _spread(spark, listed.select("path", "size", "mtime")).mapInArrow(run, f"{SCHEMA}, content_hash string")


_known: set[int] = set()


def registered(spark: SparkSession, source: type[DataSource]) -> str:
    """The name of `source`, which the session knows from now on."""
    key = hash((spark.sparkContext.applicationId, id(spark._jsparkSession), source))
    if key not in _known:
        spark.dataSource.register(source)
        _known.add(key)
    return source.name()


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime): all files under `root` that no dot hides, by paths within it."""
    return spark.read.format(registered(spark, FolderFiles)).load(root).select("path", F.col("size"), "mtime")
