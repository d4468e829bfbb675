"""Cutting note bodies into size-targeted, overlapping chunks at Markdown boundaries.

Offsets are UTF-8 bytes, sizes in tokens are characters by a ratio. Each body is one row's work:
arrays of the places where a chunk may end, with their worth, and a walk over them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions.paths import text_hash


@dataclass(frozen=True)
class Policy:
    """How chunks are cut; the numbers are fixed values."""

    target_tokens: int = 450
    overlap: float = 0.15
    chars_per_token: float = 4.0
    backscan_tokens: int = 200
    headings: tuple[int, ...] = (100, 90, 80, 70, 60, 50)
    fence: int = 80
    blank: int = 20
    item: int = 5
    paragraph: int = 3
    word: int = 1
    prepend_heading: bool = False


# Unicode white space, as bytes of a pattern on text
_SPACE = "\t\n\v\f\r \x85\xa0  -     　"
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_WORD = re.compile(f"(?<=[{_SPACE}])[^{_SPACE}]")
_HEADING = re.compile(r"(#{1,6})(?: |$)")
_ITEM = re.compile(r"[-*+] |[0-9]+[.)] ")
_FENCE = ("```", "~~~")
#: Bytes of bodies whose chunks a task holds at once, about; a larger body is alone.
TEXTS = 1 << 20


def _round(x: float) -> int:
    """Half away from zero."""
    return int(np.floor(x + 0.5))


def _strip(s: str) -> str:
    return re.sub(f"^[{_SPACE}]+|[{_SPACE}]+$", "", s)


def _survey(body: str, policy: Policy) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str | None]], list[tuple[int, int]]]:
    """Places (bytes) and worths of all boundaries, the headings in effect from each line on, and the
    spans of closed fences and tables, in which no chunk ends."""
    places, worths, headings, blocks = array("q"), array("d"), [], []  # a word is 16 bytes
    trail: dict[int, str] = {}
    fence = table = row = None
    at = 0
    for m in _LINE.finditer(body):
        line = m.group()
        end = at + len(line.encode())
        content = line.rstrip("\n").rstrip("\r")
        bare = re.sub(f"^[{_SPACE}]+", "", content)
        heading = None if fence is not None else _HEADING.match(bare)
        if bare.startswith(_FENCE):
            worth = policy.fence
            if table:
                blocks.append(table)
            table = row = None
            if fence is None:
                fence = at
            else:
                blocks.append((fence, end))
                fence = None
        else:
            if not bare:
                worth = policy.blank
            elif heading:
                level = len(heading[1])
                worth = policy.headings[level - 1]
                trail = {k: v for k, v in trail.items() if k < level} | {level: _strip(_strip(bare[level:]).rstrip("#"))}
            elif fence is None and _ITEM.match(bare):
                worth = policy.item
            else:
                worth = policy.paragraph
            if fence is None and "|" in bare:
                if table:
                    table = (table[0], end)
                elif row is not None and "-" in bare and not set(bare) - set("-:| "):
                    table = (row, end)
                else:
                    row = at
            elif fence is None:
                if table:
                    blocks.append(table)
                table = row = None
        places.append(at)
        worths.append(worth)
        headings.append((at, " > ".join(trail.values()) or None))
        if any(c in content for c in " \t ") or not content.isascii():
            starts = [w.start() for w in _WORD.finditer(content)]
            if content and content.isascii():
                places.extend([at + s for s in starts])
            else:
                places.extend([at + len(content[:s].encode()) for s in starts])
            worths.extend([policy.word] * len(starts))
        at = end
    if table:
        blocks.append(table)
    return np.array(places, np.int64), np.array(worths, np.float64), headings, sorted(blocks)


def _clear(place: int, blocks: list[tuple[int, int]]) -> int:
    """`place`, or the end of the block inside which it lies."""
    return next((b for a, b in blocks if a < place < b), place)


def chunk(body: str | None, policy: Policy = Policy()) -> list[tuple[int, int, int, int, str | None, str]]:
    """(seq, char_start, char_end, token_count, heading_path, text) of a body; a blank one has none."""
    if not body or not _strip(body):
        return []
    data = body.encode("utf-8", "surrogatepass")
    places, worths, headings, blocks = _survey(body, policy)
    ratio = max(float(np.float32(policy.chars_per_token)), 0.1)
    target = max(1, _round(policy.target_tokens * ratio))
    scan = _round(policy.backscan_tokens * ratio)
    overlap = _round(policy.target_tokens * float(np.float32(policy.overlap)) * ratio)
    spans, start = [], 0
    while len(data) - start > target:
        k = np.searchsorted(places, start + target)
        anchor = int(places[k]) if k < len(places) else len(data)
        low, high = np.searchsorted(places, max(anchor - scan, start + 1)), np.searchsorted(places, anchor, "right")
        if high > low:
            far = (anchor - places[low:high]) / ratio / max(policy.backscan_tokens, 1e-9)
            value = worths[low:high] * np.maximum(1 - far, 0) ** 2
            end = int(places[high - 1 - int(np.argmax(value[::-1]))])  # the later of equals
        else:
            end = anchor
        end = _clear(end, blocks)
        spans.append((start, end))
        if end >= len(data):
            break
        low, high = np.searchsorted(places, start, "right"), np.searchsorted(places, end)
        start = end
        if overlap and high > low:
            away = np.abs(places[low:high] - max(0, end - overlap))
            nearest = np.flatnonzero(away == away.min())
            start = int(places[low + nearest[int(np.argmax(worths[low:high][nearest]))]])  # the worthier, then the earlier
        start = _clear(start, blocks)
    else:
        spans.append((start, len(data)))
    out, starts = [], [a for a, _ in headings]
    for a, b in spans:
        raw = data[a:b].decode("utf-8", "surrogatepass")
        lead = re.match(f"[{_SPACE}]*", raw).group()
        text = _strip(raw)
        if not text:
            continue
        a += len(lead.encode())
        path = headings[int(np.searchsorted(starts, a, "right")) - 1][1]
        shown = f"{path}\n\n{text}" if policy.prepend_heading and path else text
        out.append((len(out), a, a + len(text.encode("utf-8", "surrogatepass")), _round(len(text) / ratio), path, shown))
    return out


def chunks(notes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The chunks table of notes (path, body)."""
    schema = schemas.CHUNKS.rpartition(",")[0]
    return notes.select("path", "body").mapInArrow(_cut(policy), schema).withColumn("text_hash", text_hash(F.col("text")))


def _cut(policy: Policy) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over (path, body) that gives the chunks of about TEXTS bytes of bodies at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for path, body in zip(b.column("path"), b.column("body"), strict=True):
                rows += [(path.as_py(), *c) for c in chunk(body.as_py(), policy)]
                size += body.as_buffer().size if body.is_valid else 0
                if size >= TEXTS:
                    yield _table(rows)
                    rows, size = [], 0
            yield _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    """(note_path, seq, char_start, char_end, token_count, heading_path, text)"""
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]
    names = ["note_path", "seq", "char_start", "char_end", "token_count", "heading_path", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
