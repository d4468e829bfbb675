"""A folder as a stream of changes: files that were created, changed or deleted since the batch before.

An offset is the number of a snapshot: a listing of the folder, written in shards by path. A batch is the difference of
two snapshots, found shard by shard in tasks, so that the same two numbers give the same batch whenever it runs. A task
hashes the files that are new in its shard and leaves all hashes of the shard with the later snapshot, from which the next
batch takes them: a deleted file still has the hash it had.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillspark.sources.reader import digest, registered, store, walk

SCHEMA = "path string, change string, hash string"
_LISTED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])
_HASHES = pa.schema([("path", pa.string()), ("hash", pa.string())])
#: Rows that a shard's writer holds before it writes them.
ROWS = 8192


@dataclass
class Shard(InputPartition):
    start: int
    end: int
    shard: int

    def __init__(self, start: int, end: int, shard: int):
        super().__init__((start, end, shard))
        self.start, self.end, self.shard = start, end, shard


class Snapshots:
    """The numbered listings of `root` in the folder `state`, each in so many `shards`."""

    def __init__(self, root: str, state: str, shards: int):
        self.root, self.state, self.shards = root, state, shards

    def _at(self) -> tuple[fs.FileSystem, str]:
        return store(self.state)

    def last(self) -> tuple[int, list[int]]:
        """The number of the last whole snapshot, 0 without one, and its shards' sums."""
        files, top = self._at()
        found = [int(x.base_name[9:-5]) for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.base_name.startswith("snapshot-") and x.base_name.endswith(".json")]
        if not found:
            return 0, []
        with files.open_input_file(f"{top}/snapshot-{max(found):08d}.json") as f:
            return max(found), json.loads(f.read())

    def taken(self) -> int:
        """Lists the folder and returns the number of the snapshot that has it as it is: the last one's, or a new one's. The
        names pass through a shard's writer each, so that none but a few are held; a snapshot counts once its sums are there."""
        files, top = self._at()
        source, root = store(self.root)
        n, before = self.last()
        temp = f"{top}/taking-{uuid.uuid4().hex}"
        files.create_dir(temp)
        sums, held, writers = [0] * self.shards, [[] for _ in range(self.shards)], {}

        def flush(k: int) -> None:
            if k not in writers:
                writers[k] = pq.ParquetWriter(files.open_output_stream(f"{temp}/{k}.parquet"), _LISTED)
            writers[k].write_table(pa.Table.from_pylist([dict(zip(_LISTED.names, r, strict=True)) for r in held[k]], _LISTED))
            held[k] = []

        for rows in walk(source, root, ""):
            for row in rows:
                k = zlib.crc32(row[0].encode()) % self.shards
                # the order of a listing doesn't count, so rows' sums are added
                sums[k] += int.from_bytes(_row_sum(row), "little")
                held[k].append(row)
                if len(held[k]) >= ROWS:
                    flush(k)
        for k in range(self.shards):
            flush(k)
            writers[k].close()
        sums = [s % (1 << 128) for s in sums]
        if n and sums == before:
            files.delete_dir(temp)
            return n
        files.move(temp, f"{top}/snapshot-{n + 1:08d}")
        with files.open_output_stream(f"{temp}.json") as f:
            f.write(json.dumps(sums).encode())
        files.move(f"{temp}.json", f"{top}/snapshot-{n + 1:08d}.json")
        return n + 1

    def listed(self, n: int, shard: int) -> dict[str, tuple[int, int]]:
        if n == 0:
            return {}
        files, top = self._at()
        t = pq.read_table(f"{top}/snapshot-{n:08d}/{shard}.parquet", filesystem=files)
        return {p: (s, m) for p, s, m in zip(*(t[c].to_pylist() for c in _LISTED.names), strict=True)}

    def hashes(self, n: int, shard: int) -> dict[str, str]:
        files, top = self._at()
        at = f"{top}/hashes-{n:08d}-{shard}.parquet"
        if n == 0 or files.get_file_info(at).type != fs.FileType.File:
            return {}
        t = pq.read_table(at, filesystem=files)
        return dict(zip(t["path"].to_pylist(), t["hash"].to_pylist(), strict=True))

    def keep(self, n: int, shard: int, hashes: dict[str, str | None]) -> None:
        """Leaves a shard's hashes with a snapshot; whoever does so again leaves the same."""
        files, top = self._at()
        temp = f"{top}/taking-{uuid.uuid4().hex}"
        with files.open_output_stream(temp) as f:
            pq.write_table(pa.table({"path": list(hashes), "hash": list(hashes.values())}, _HASHES), f)
        files.move(temp, f"{top}/hashes-{n:08d}-{shard}.parquet")

    def drop_before(self, n: int) -> None:
        files, top = self._at()
        for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            kind, _, rest = x.base_name.partition("-")
            if kind in ("snapshot", "hashes") and rest[:8].isdigit() and int(rest[:8]) < n:
                (files.delete_dir if x.type == fs.FileType.Directory else files.delete_file)(x.path)


def _row_sum(row: tuple[str, int, int]) -> bytes:
    return hashlib.blake2b(repr(row).encode(), digest_size=16).digest()


class _Changes(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.own = Snapshots(options["path"], options["state"], int(options.get("shards", "16")))

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        return {"snapshot": self.own.taken()}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        a, b = start["snapshot"], end["snapshot"]
        return [Shard(a, b, k) for k in range(self.own.shards)] if a != b else []

    def read(self, partition: Shard) -> Iterator[tuple]:
        own, k = self.own, partition.shard
        before, after, was = own.listed(partition.start, k), own.listed(partition.end, k), own.hashes(partition.start, k)
        files, top = store(own.root)
        # a batch that runs again finds the hashes that it left the first time, whatever became of the files
        now = own.hashes(partition.end, k)
        if not now:
            now = {p: was[p] if p in was and before.get(p) == seen else digest(files, f"{top}/{p}") for p, seen in after.items()}
            own.keep(partition.end, k, now)
        for path in sorted(before.keys() | after.keys()):
            if path not in after:
                yield path, "deleted", was.get(path)
            elif path not in before:
                yield path, "created", now[path]
            elif before[path] != after[path]:
                yield path, "changed", now[path]

    def commit(self, end: dict) -> None:
        self.own.drop_before(end["snapshot"])


class FolderChanges(DataSource):
    """spark.readStream.format("quillspark_changes").option("state", folder).load(root)"""

    @classmethod
    def name(cls) -> str:
        return "quillspark_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


def changes(spark: SparkSession, root: str, state: str, shards: int = 16) -> DataFrame:
    """A stream of (path, change, hash): what was created, changed or deleted under `root`, no dot hiding it, since the batch
    before. `state` is a folder of the stream's own, outside `root` or hidden in it, that driver and executors share. A task
    holds the paths of a shard, so `shards` should grow with the folder."""
    return spark.readStream.format(registered(spark, FolderChanges)).option("state", state).option("shards", shards).load(root)
