"""Changes to a vault's folder: all of them, or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


#: The file of a change's folder that says which renames make it.
INTENT = "intent.json"


def _store(spark: SparkSession, root: str):
    """The file system of `root`, and Hadoop's Path. Local folders are written without checksum files,
    which would be wrong as soon as another program edits a note."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), path


def read(spark: SparkSession, root: str, at: str) -> bytes | None:
    """The content of one file, whatever its name starts with; None where there is none."""
    fs, path = _store(spark, root)
    file = path(f"{root}/{at}")
    if not fs.exists(file) or fs.getFileStatus(file).isDirectory():
        return None
    stream = fs.open(file)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def exists(spark: SparkSession, root: str, at: str) -> bool:
    fs, path = _store(spark, root)
    return fs.exists(path(f"{root}/{at}"))


def is_folder(spark: SparkSession, root: str, at: str) -> bool:
    fs, path = _store(spark, root)
    at = path(f"{root}/{at}")
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def make_folder(spark: SparkSession, root: str, at: str) -> bool:
    """Makes a folder and those above it; False where there is one."""
    fs, path = _store(spark, root)
    if fs.exists(path(f"{root}/{at}")):
        return False
    return fs.mkdirs(path(f"{root}/{at}"))


def folders(spark: SparkSession, root: str) -> list[str]:
    """Every folder under `root` that no dot hides, empty ones too, sorted."""
    fs, path = _store(spark, root)
    base = fs.makeQualified(path(root)).toString().rstrip("/") + "/"
    found, todo = [], [path(root)]
    while todo:
        for f in fs.listStatus(todo.pop()):
            if f.isDirectory() and not f.getPath().getName().startswith("."):
                todo.append(f.getPath())
                found.append(fs.makeQualified(f.getPath()).toString().removeprefix(base))
    return sorted(found)


def apply(spark: SparkSession, root: str, contents: DataFrame | None = None, renames: Iterable[tuple[str, str]] = (), gone: Iterable[str] = (), then: Callable[[], object] | None = None, mark: int = 0) -> list[str]:
    """Renames files or folders, writes contents (path, content) and takes `gone` away; the written paths, sorted.

    Contents are written one after the other to a hidden folder first, with an intent: all renames that are to come, and
    `mark`, the number of the index before. All that follows is a rename, so that a failure, of these or of
    `then`, which brings the index up to the folder, is undone by the same renames backwards, and the folder is as it was.
    What a process that died has left, `recover` finishes or undoes.
    """
    fs, path = _store(spark, root)
    stage, done, staged = f"{root}/.changes-{uuid.uuid4().hex}", [], []

    def put(a: str, b: str) -> None:
        fs.mkdirs(path(f"{root}/{b}").getParent())
        if not fs.exists(path(f"{root}/{a}")) or not fs.rename(path(f"{root}/{a}"), path(f"{root}/{b}")):
            raise OSError(f"can't rename {a} to {b}")
        done.append((a, b))

    def write(at: str, content: bytes) -> None:
        out = fs.create(path(at))
        out.write(bytearray(content))
        out.close()

    try:
        for n, row in enumerate(contents.toLocalIterator() if contents is not None else ()):
            write(f"{stage}/new-{n}", row["content"])
            staged.append(row["path"])
        hidden, moves = stage.rpartition("/")[2], list(renames)
        moved = lambda at: next((at for old, new in moves if at == new or at.startswith(f"{new}/")), None)
        steps = list(moves)
        for n, at in enumerate(staged):
            if moved(at) or fs.exists(path(f"{root}/{at}")):
                steps.append((at, f"{hidden}/old-{n}"))
            steps.append((f"{hidden}/new-{n}", at))
        steps += [(at, f"{hidden}/gone-{n}") for n, at in enumerate(gone)]
        write(f"{stage}/{INTENT}", json.dumps({"steps": steps, "mark": mark}).encode())
        for a, b in steps:
            put(a, b)
        if then is not None:
            then()
    except Exception:
        _back(fs, path, root, done)
        raise
    finally:
        fs.delete(path(stage), True)
    return sorted(staged)


def _back(fs, path, root: str, steps: list) -> None:
    for a, b in reversed(steps):
        if fs.exists(path(f"{root}/{b}")) and not fs.exists(path(f"{root}/{a}")):
            fs.mkdirs(path(f"{root}/{a}").getParent())
            fs.rename(path(f"{root}/{b}"), path(f"{root}/{a}"))


def recover(spark: SparkSession, root: str, mark: int) -> dict[str, int]:
    """Finishes or undoes changes that a process left when it died: one after which the index got a number over its own is whole, any
    other goes back. For a time when nobody else changes the folder. Returns how many were {finished, undone}."""
    fs, path = _store(spark, root)
    told = {"finished": 0, "undone": 0}
    for f in fs.listStatus(path(root)) if fs.exists(path(root)) else []:
        name = f.getPath().getName()
        if not f.isDirectory() or not name.startswith(".changes-"):
            continue
        found = read(spark, root, f"{name}/{INTENT}")
        if found is not None:  # without an intent nothing was renamed yet
            intent = json.loads(found)
            whole = mark > intent["mark"]
            if not whole:
                _back(fs, path, root, intent["steps"])
            told["finished" if whole else "undone"] += 1
        fs.delete(f.getPath(), True)
    return told
