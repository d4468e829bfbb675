"""Notes from files: the frontmatter's span by expressions, its fields by a small reader of nested values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import nested
from quillspark.functions.paths import text_hash

_SPAN = "(?s)^(---[ \\t]*\\r?\\n(?:.*?\\n)??---[ \\t]*(?:\\r?\\n|$))(.*)$"
_FIELDS = ("type", "title", "description", "created", "updated")
_LISTS = ("aliases", "tags", "relations")


def span(text: Column) -> Column:
    """The frontmatter block with its fences; empty without one."""
    return F.regexp_extract(text, _SPAN, 1)


def body(text: Column) -> Column:
    return F.when(span(text) == "", text).otherwise(F.regexp_extract(text, _SPAN, 2))


def fields(block: str | None) -> tuple[dict, bool]:
    """(key to scalar, list or map, whether the block could be read)."""
    try:
        return nested.tree((block or "").splitlines()[1:-1]), True
    except nested.Unreadable:
        return {}, False


def _text(value, dates: bool = False) -> str | None:
    return value if isinstance(value, str) else str(value) if dates and value is not None and not isinstance(value, (list, dict, bool)) else None


def notes(files: DataFrame, relations_key: str = "relations") -> DataFrame:
    """The notes table of files (path, content, mtime and, where there is one, reason) and the reason of each that can't be read.

    Content that is no UTF-8 gives a row with a null body and reason. Fields that aren't text are
    null, dates stay strings, and a block that can't be read leaves the fields empty. properties is all of the block, at
    any depth, as a variant.
    """
    why = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    rows = files.withColumn("why", why).withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    rows = rows.select("path", "mtime", span(F.col("text")).alias("block"), body(F.col("text")).alias("body"), F.coalesce("why", F.when(F.col("text").isNull(), "is not valid UTF-8")).alias("reason"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [fields(x) for x in b["block"]]
            out = b[["path", "mtime", "body", "reason"]].copy()
            for name in _FIELDS:
                out[name] = [_text(f.get(name), name in ("created", "updated")) for f, _ in own]
            for name in _LISTS:
                key = relations_key if name == "relations" else name
                out[name] = [[x for x in f.get(key, []) if isinstance(x, str)] if isinstance(f.get(key), list) else [f[key]] if isinstance(f.get(key), str) else [] for f, _ in own]
            out["readable"] = [ok for _, ok in own]
            out["properties"] = [nested.as_json(f) for f, _ in own]
            yield out

    schema = "path string, mtime long, body string, reason string, type string, title string, description string, created string, updated string, aliases array<string>, tags array<string>, relations array<string>, readable boolean, properties string"
    return rows.mapInPandas(run, schema).withColumn("properties", F.try_parse_json("properties")).withColumn("body_hash", text_hash(F.col("body")))
