"""Derived tables in buckets, in versioned folders; a small manifest names the folders that hold."""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark import schemas


class Catalog:
    """The tables of one index under `root`. Writers make new folders and then a manifest of the next
    number; the highest holds, so readers always see one whole index, and of two writers one fails. Another layout
    version or a missing manifest is no index.

    A table lies in `buckets` parts by the hash of its key (schemas.KEYS). The manifest has for each bucket
    the folders whose rows are in it, so that a commit writes the buckets it touches and no others. The
    number of buckets is the index's own: it is set when the index is made.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        top = path(self.root)
        return top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _manifest(self, n: int) -> str:
        return f"{self.root}/manifest-{n:08d}.json"

    def _latest(self) -> int:
        """The number of the manifest that holds; 0 without one."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path(self.root))]
        return max((int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", x) for x in names) if m), default=0)

    def number(self) -> int:
        """The number of the manifest that holds; each commit has a higher one."""
        return self._latest()

    def manifest(self) -> dict:
        """tables (name to schema and folders by bucket), buckets, model and dim; empty without an index of this layout."""
        n = self._latest()
        if not n:
            return {}
        found = json.loads("\n".join(r["value"] for r in self.spark.read.text(self._manifest(n)).collect()))
        return found if found.get("version") == schemas.VERSION else {}

    def bucket(self, key: Column, manifest: dict | None = None) -> Column:
        """The bucket of a row with `key`."""
        n = (self.manifest() if manifest is None else manifest).get("buckets", self._buckets)
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that `rows` are in; there are as many as the index has at most."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(key))).distinct().collect())

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table or some buckets of it, or None where the index has none: an absent table isn't an empty one."""
        own = self.manifest().get("tables", {}).get(name)
        if own is None:
            return None
        schema = StructType.fromJson(own["schema"])
        at = [f"{self.root}/{x}" for b, found in own["folders"].items() if buckets is None or int(b) in buckets for x in found]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _written(self, name: str, df: DataFrame, manifest: dict) -> dict[str, list[str]]:
        """Writes rows to a new folder and returns its parts by bucket. Large buckets are written by several tasks."""
        at = f"{schemas.VERSION}/{name}-{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self.bucket(F.col(schemas.KEYS[name]), manifest))
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{at}")
        fs, path = self._fs()
        parts = [f.getPath().getName() for f in fs.listStatus(path(f"{self.root}/{at}")) if f.isDirectory()]
        return {x.removeprefix("_bucket="): [f"{at}/{x}"] for x in parts if x.startswith("_bucket=")}

    def commit(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), replace: dict[str, tuple[DataFrame, list[int]]] | None = None, append: dict[str, DataFrame] | None = None, **more) -> dict:
        """Writes whole `tables`, all rows of the buckets that `replace` (name to rows and buckets) names, and rows
        that `append` adds, to new folders, and makes them, with all that stays, the index. Returns the buckets written, by table."""
        n, old = self._latest(), self.manifest()
        base = {"buckets": old.get("buckets", self._buckets)}
        names = {k: v for k, v in old.get("tables", {}).items() if k not in drop}
        wrote: dict[str, list[int]] = {}
        todo = [(k, df, None) for k, df in tables.items()] + [(k, df, bs) for k, (df, bs) in (replace or {}).items()] + [(k, df, "more") for k, df in (append or {}).items()]
        # tables don't wait for one another; jobs keep the tags of the caller
        write = inheritable_thread_target(self.spark)(lambda x: self._written(x[0], x[1], base))
        with ThreadPoolExecutor(max(1, len(todo))) as pool:
            done = list(pool.map(write, todo))
        for (name, df, buckets), parts in zip(todo, done, strict=True):
            wrote[name] = sorted(map(int, parts))
            held = names.get(name, {}).get("folders", {})
            if buckets is None:
                held = {}
            elif buckets == "more":
                parts = {b: held.get(b, []) + x for b, x in parts.items()}
            else:
                held = {b: x for b, x in held.items() if int(b) not in buckets}
                if not {int(b) for b in parts} <= set(buckets):
                    raise ValueError(f"rows of {name} beyond the buckets that are replaced")
            names[name] = {"schema": json.loads(df.schema.json()), "folders": held | parts}
        new = {k: v for k, v in old.items() if k not in ("tables", "version")} | base | more | {"version": schemas.VERSION, "tables": names}
        self._publish(new, n + 1)
        return wrote

    def _publish(self, manifest: dict, n: int) -> None:
        fs, path = self._fs()
        temp = path(f"{self.root}/writing.{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        at = path(self._manifest(n))
        if fs.exists(at) or not fs.rename(temp, at):
            raise RuntimeError("another writer was first")

    def vacuum(self) -> None:
        """Removes the folders that the manifest no longer names; call it when no reader is left on them."""
        fs, path = self._fs()
        top = path(f"{self.root}/{schemas.VERSION}")
        last = self._latest()
        for f in fs.listStatus(path(self.root)) if last else []:
            m = re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName())
            if m and int(m[1]) < last:
                fs.delete(f.getPath(), False)
        held = {x for own in self.manifest().get("tables", {}).values() for found in own["folders"].values() for x in found}
        tops = {x.split("/")[1] for x in held}
        for f in fs.listStatus(top) if fs.exists(top) else []:
            name = f.getPath().getName()
            if name not in tops:
                fs.delete(f.getPath(), True)
                continue
            for part in fs.listStatus(f.getPath()):
                if part.isDirectory() and f"{schemas.VERSION}/{name}/{part.getPath().getName()}" not in held:
                    fs.delete(part.getPath(), True)
