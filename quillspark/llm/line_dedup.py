"""Line dedup by pairwise alignment.

From each line of a document, a run of as few lines as make a block is hashed. A run that several documents
have links each later holder to the earliest one; the runs of such a pair are aligned by patience diff, rare
ones first, and what is aligned goes from the later document. Any block is made of such runs,
each of which has an earliest holder of its own, so no block is lost where these differ.
One alignment keeps one order, so what it leaves is aligned again, until nothing is left.
Long lines are cut at sentence ends, so that a passage is found inside a longer line as well.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillspark.llm.common import cut, fresh, tidy

#: Documents that hold a rare run, at most.
RARE = 64
#: Words after which a sentence's end ends a line.
LINE_WORDS = 5
#: Rows whose lines are cut at once.
ROWS = 512
_ENDS = re.compile(r"(?<=[.!?])(?= )|(?<=\n)")


def cut_lines(text: str | None) -> list[tuple[str, int]]:
    """(line, words) of a whole text; the lines, joined, are the text. A line ends after a line feed,
    and before the blank after a sentence's end once it has LINE_WORDS words."""
    out, held, words = [], "", 0
    for piece in _ENDS.split(text or ""):
        held += piece
        words += len(piece.split())
        if words >= LINE_WORDS or piece.endswith("\n"):
            out.append((held, words))
            held, words = "", 0
    if held:
        out.append((held, words))
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of `pairs`, sorted by the first number, in which the second one grows too."""
    tails, at, back = [], [], [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tails, b)
        if i == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[i], at[i] = b, k
        back[k] = at[i - 1] if i else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(pairs: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Patience alignment of two documents from their common lines (place in the later, place in the
    earlier, rare). Rare lines are aligned first; the others only where they keep that order."""
    rows = sorted(set(pairs), key=lambda x: (x[0], -x[1]))  # of one line's partners, one at most fits an order
    anchors = _increasing([(a, b) for a, b, rare in rows if rare])
    out, bounds, i = [], [(-1, -1), *anchors, (1 << 62, 1 << 62)], 0
    for (a0, b0), (a1, b1) in zip(bounds, bounds[1:], strict=False):
        between = []
        while i < len(rows) and rows[i][0] < a1:
            a, b, _ = rows[i]
            if a > a0 and b0 < b < b1:
                between.append((a, b))
            i += 1
        out += _increasing(between)
        if a1 < 1 << 62:
            out.append((a1, b1))
    return out


def blocks(aligned: list[tuple[int, int]], words: dict[int, int], least: int) -> list[int]:
    """Places in the later document that lie in blocks, aligned lines which follow each other in both
    documents, of at least `least` words."""
    out, run = [], []
    for a, b in [*aligned, (-9, -9)]:
        if run and (a, b) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[x] for x, _ in run) >= least:
                out += [x for x, _ in run]
            run = []
        run.append((a, b))
    return out


def dealt(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """`pairs` as few runs in which both numbers grow, dealt as in patience sorting: each goes to the run whose
    last second number is the largest below its own, so that neighbours stay together."""
    runs, tops, at = [], [], []
    for a, b in sorted(pairs, key=lambda x: (x[0], -x[1])):
        i = bisect_left(tops, b)
        if i:
            tops[i - 1] = b
            runs[at[i - 1]].append((a, b))
        else:
            tops.insert(0, b)
            at.insert(0, len(runs))
            runs.append([(a, b)])
    return runs


def orders(pairs: list[tuple[int, int, bool]]) -> Iterator[list[tuple[int, int]]]:
    """Alignments of two documents one after the other, which together hold all `pairs`: the patience alignment,
    then alignments of what it leaves, passages that the documents have in another order."""
    first = align(pairs)
    if first:
        yield first
        yield from dealt(list({(a, b) for a, b, _ in pairs} - set(first)))


def common_blocks(pairs: list[tuple[int, int, bool]], words: dict[int, int], least: int) -> list[int]:
    """Places in the later document, ascending, that lie in blocks of at least `least` words of any of the
    documents' alignments."""
    return sorted({place for aligned in orders(pairs) for place in blocks(aligned, words, least)})


def with_blanks(cut: list[tuple[str, int]], gone: list[int]) -> list[int]:
    """Places among all lines of the lines `gone`, numbered without blank ones, and of the blank lines
    that stand between two of them."""
    full, held = [k for k, (_, n) in enumerate(cut) if n], set(gone)
    out: list[int] = []
    for g in sorted(held):
        if g < len(full):
            out += range(full[g - 1] + 1, full[g] + 1) if g - 1 in held else [full[g]]
    return out


def _text_key(text: str | None) -> int:
    """A text's number among those of its doc_id, as a signed long."""
    h = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _shortest(words: list[int], least: int) -> list[int]:
    """For each line that begins one, how many lines the shortest run of at least `least` words has."""
    out, end, held = [], 0, 0
    for k, n in enumerate(words):
        while end < len(words) and held < least:
            held += words[end]
            end += 1
        if held < least:
            break
        out.append(end - k)
        held -= n
    return out


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest run of at least `least` words from each line, and of the
    shortest up to each line: every line of a longer run lies in one of these that is within it."""
    back = _shortest(words[::-1], least)
    return sorted({*enumerate(_shortest(words, least)), *((len(words) - k - m, m) for k, m in enumerate(back))})


def runs(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, t, place, lines, h, g): each run of lines of `least` words or more that has no shorter one at its
    beginning or at its end. place is the number of its first line among those that aren't blank, t is a hash of the text. h and g are a 128-bit hash of the lines, without white space at their
    ends, and of how often the document had the run before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, texts, places, sizes, hashes = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                own = [x for x in cut_lines(text) if x[1]]
                counts = [n for _, n in own]
                spans = windows(counts, least)
                if not spans:
                    continue
                each, had = [digest(x.strip().encode("utf-8", "surrogatepass")) for x, _ in own], {}
                for k, m in spans:
                    h = each[k] if m == 1 else digest(b"".join(each[k : k + m]))
                    nth = had.get(h, 0)
                    had[h] = nth + 1
                    hashes.append(digest(h + nth.to_bytes(8, "little")) if nth else h)
                ids += [doc_id] * len(spans)
                texts += [_text_key(text)] * len(spans)
                places += [k for k, _ in spans]
                sizes += [m for _, m in spans]
            pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "place", "lines", "h", "g"])

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, t long, place int, lines int, h long, g long")


def repeated(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, t, places array<int>): the lines of each text that lie in blocks of `least` words or more which
    an earlier document (smaller doc_id) has as well. Blank lines have no number.

    A run pairs each later holder with its earliest one alone: a run that very many documents
    share makes as many pairs, not their square.
    """
    own = cut(runs(docs, least))
    first = own.groupBy("h", "g").agg(F.min(F.struct("doc_id", "place")).alias("e"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first.select("h", "g", F.col("e.doc_id").alias("early"), F.col("e.place").alias("early_place"), (F.col("n") <= RARE).alias("rare")))
    pairs = own.join(first, ["h", "g"]).filter("doc_id > early")
    grouped = pairs.groupBy("doc_id", "t", "early").agg(F.collect_list(F.struct("place", "early_place", "rare", "lines")).alias("pairs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places = []
            for pairs in b["pairs"]:
                rows, lines = [], {}
                for p in pairs:
                    a = int(p["place"])
                    rows.append((a, int(p["early_place"]), bool(p["rare"])))
                    lines[a] = max(int(p["lines"]), lines.get(a, 0))
                # what is aligned here are runs, each a block by itself
                starts = common_blocks(rows, dict.fromkeys(lines, least), least)
                places.append(sorted({a + i for a in starts for i in range(lines[a])}))
            # an object column, so that lists are lists even where all are empty
            yield pd.DataFrame({"doc_id": b["doc_id"], "t": b["t"], "places": pd.Series(places, b.index, object)})

    gone = grouped.mapInPandas(tidy(run), "doc_id long, t long, places array<int>")
    return gone.groupBy("doc_id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")).filter(F.size("places") > 0)


def line_dedup(docs: DataFrame, least: int = 8) -> DataFrame:
    """`docs` (doc_id, text, more) with text without the repeated lines, removed (their places among
    the text's lines, from 0, ascending) and removed_words.

    The earliest document keeps what it shares, and blocks of fewer than `least` words stay
    everywhere. Blank lines cut no block, and go between two lines that go. A null or empty text stays; a row
    with a null doc_id stays as it is. Rows with the same doc_id don't lose lines to each other. Columns named like the
    new ones give way. An empty table gives no rows.
    """
    docs = docs.drop("removed", "removed_words")
    doc, places = fresh(docs, "gone_id", "gone_places")
    gone = cut(repeated(docs, least)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "places"))).alias(places)).withColumnRenamed("doc_id", doc)
    schema = StructType([*docs.schema.fields, StructField("removed", ArrayType(IntegerType())), StructField("removed_words", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                b = whole.slice(k, ROWS)
                at, texts = b.schema.get_field_index("text"), b.column("text").to_pylist()
                removed, words = [], []
                for i, gone in enumerate(b.column(places).to_pylist()):
                    removed.append([])
                    words.append(0)
                    mine = dict(gone or ()).get(_text_key(texts[i]) if gone else None)
                    if mine:
                        own = cut_lines(texts[i])
                        removed[-1] = with_blanks(own, mine)
                        away = set(removed[-1])
                        words[-1] = sum(own[j][1] for j in away)
                        texts[i] = "".join(line for j, (line, _) in enumerate(own) if j not in away)
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n not in (doc, places)]
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(removed, pa.list_(pa.int32())), pa.array(words, pa.int64())], [*[n for n, _ in kept], "removed", "removed_words"])

    rows = docs.join(gone, docs["doc_id"] == gone[doc], "left")
    # whole rows go through Python: a UDF column would keep them on disk meanwhile
    return rows.mapInArrow(tidy(run), schema)
