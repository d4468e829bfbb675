"""Token ids in wavelet matrices, one for each shard, in compressed files, searched without unpacking ids.

Documents are encoded in ascending doc_id order and cut into shards; a task writes its shards as the rows of
one file. A shard's ids are stored as
bit planes, the highest bit first; after each plane the ids are reordered, those with a 0 before
those with a 1, so that rank on the planes gives access, counts and the places of any id.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from array import array
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import HELD, by_ranges, shared_dir, tidy

#: Ids after which a shard is closed; a shard holds whole documents.
SHARD_IDS = 1 << 21
BLOCK = 512
_SHARD = "part int, seq int, n_ids long, doc_ids array<long>, doc_lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Bit planes of a sequence of ids, with counts of ones before each block of 512 bits."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        x, zeros, planes, ranks = np.asarray(ids, np.uint16 if bits <= 16 else np.uint32), [], [], []
        for level in range(bits - 1, -1, -1):
            one = ((x >> level) & 1).astype(bool)
            plane = np.zeros(-(-len(x) // BLOCK) * (BLOCK // 8), np.uint8)
            packed = np.packbits(one, bitorder="little")
            plane[: len(packed)] = packed
            per = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
            planes.append(plane)
            ranks.append((np.cumsum(per) - per).astype(np.uint32))
            low = np.flatnonzero(~one)
            zeros.append(len(low))
            y = np.empty_like(x)
            np.take(x, low, out=y[: len(low)], mode="clip")
            np.take(x, np.flatnonzero(one), out=y[len(low) :], mode="clip")
            x = y
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block = i // BLOCK
        part = self.planes[level][block * (BLOCK // 8) : i // 8]
        last = int(self.planes[level][i // 8]) & ((1 << i % 8) - 1)
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) + last.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> i % 8 & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            ones, bit = self._ones(level, i), self._bit(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        bits = len(self.planes)
        if value >> bits:
            return 0, 0
        for level in range(bits):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if value >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs in places low to high."""
        a, b = self._range(value, low, self.n if high is None else min(high, self.n))
        return max(0, b - a)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a plane that equals `bit`."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        low, high = self._range(value, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        bits = len(self.planes)
        x = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(x)
            back[np.flatnonzero(~one)] = x[: self.zeros[level]]
            back[np.flatnonzero(one)] = x[self.zeros[level] :] | x.dtype.type(1 << (bits - 1 - level))
            x = back
        return x

    @classmethod
    def stored(cls, row: dict) -> WaveletMatrix:
        """From a row of a shard file."""
        return cls(row["n_ids"], row["zeros"], [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(r, "<u4") for r in row["ranks"]])


# A byte-level vocabulary writes each byte as a letter: printable ones as themselves, the others from 256 on
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}

#: A full stop or comma after a letter or digit, and one after anything else.
_MARK, _ODD_MARK = re.compile(r"(?<=[^\W_])[.,]"), re.compile(r"[.,](?<![^\W_][.,])")


class Encoder:
    """Texts to ids by the tokenizers library, each distinct word once.

    Byte-level BPE never merges over the start of a word, nor between a word's last letter and the
    punctuation after it, so a text whose white space is single blanks and line ends is cut before each of
    these, after line ends, and before full stops and commas after a letter or digit; the ids of words already
    seen are taken from a table. Any other text goes to the
    library whole, as does one that holds an added token's string: to the library that is the token,
    unless `plain` makes special tokens' strings ordinary text. The table stops growing at `kept` words.
    """

    LONGEST, STEP = 40, 2048

    def __init__(self, path: str, end: int = 0, kept: int = 450_000, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.model = self.tokenizer.model
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kept = kept
        #: a word's place in the tables of first ids and numbers of ids; the end of a text is a word of its own,
        #: and so is the mark of a text that goes to the library whole
        self.index = {"\1": 0, "\2": 1}
        self.ids, self.first, self.size = array("I", [end]), array("q", [0, 1]), array("q", [1, 0])

    @staticmethod
    def _regular(text: str) -> bool:
        """Whether all white space is single blanks and line ends between words, and nothing is a control character."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return False
        return text.replace("\n", " ").isprintable()  # of white space, the blank alone is printable

    @staticmethod
    def _marked(text: str) -> str:
        """The text with a cut before each full stop and comma that stands after a letter or digit."""
        if _ODD_MARK.search(text):
            return _MARK.sub("\0\\g<0>", text)
        return text.replace(".", "\0.").replace(",", "\0,")

    def _append(self, ids: list[int]) -> None:
        self.first.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)

    def _add(self, words: list[str]) -> None:
        """Takes new words into the table.

        Letters alone, with a blank before them or not, are one piece to the library's own splitting,
        and go to its BPE model directly.
        """
        blank = chr(_BYTE_LETTERS[32])
        for word in words:
            if (word[1:] if word[0] == " " else word).isalpha():
                if word.isascii():
                    piece = blank + word[1:] if word[0] == " " else word
                else:
                    piece = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = [k.id for k in self.model.tokenize(piece)]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            self.index[word] = len(self.first)
            self._append(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and each text's number of ids."""
        lines, whole = [], []
        for text in texts:
            if text and self._regular(text) and not any(t in text for t in self.added):
                lines.append(self._marked(text) + "\0\1\0")
            elif text:
                lines.append("\2\0\1\0")
                whole.append(text)
            else:
                lines.append("\1\0")
        cut = "".join(lines).replace(" ", "\0 ").replace("\n", "\0\n\0")
        words = pc.split_pattern(pa.array([cut], pa.large_string()), "\0").flatten()
        words = words.slice(0, len(words) - 1).dictionary_encode()  # nothing stands after the last cut
        own, had, rows = words.dictionary.to_pylist(), len(self.index), len(self.first)
        place = np.fromiter(map(self.index.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(place < 0)
        self._add([own[i] for i in new.tolist()])
        place[new] = np.arange(rows, rows + len(new))
        at = place[words.indices.to_numpy()]
        kept = len(self.first)
        for text in whole:
            self._append(self.tokenizer.encode(text, add_special_tokens=False).ids)
        at[at == 1] = np.arange(kept, len(self.first))
        ids, first, size = (np.frombuffer(x, t) for x, t in ((self.ids, np.uint32), (self.first, np.int64), (self.size, np.int64)))
        start, n = first[at], size[at]
        total = int(n.sum())
        small = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        place = np.repeat((start - np.cumsum(n) + n).astype(small), n)
        place += np.arange(total, dtype=small)
        out = ids.take(place)
        del ids, first, size  # the tables can't grow while they are looked at
        self._shorten(kept)
        self._forget(had, rows)
        return out, np.diff(np.cumsum(n)[at == 0], prepend=0)

    def _shorten(self, rows: int) -> None:
        """Drops all rows of the table after the first `rows`."""
        if rows < len(self.first):
            del self.ids[self.first[rows] :], self.first[rows:], self.size[rows:]

    def _forget(self, had: int, rows: int) -> None:
        """Drops all that came after the first `had` words if the table is full, else the very long words among it."""
        if had > self.kept or len(self.ids) > 16 * self.kept:
            for word in list(islice(reversed(self.index), len(self.index) - had)):
                del self.index[word]
            self._shorten(rows)
        else:
            for word in [w for w in islice(reversed(self.index), len(self.index) - had) if len(w) > self.LONGEST]:
                del self.index[word]


_encoders: dict[tuple[str, int, bool], Encoder] = {}
HELD.append(_encoders)


def _encoder(path: str, end: int, plain: bool = True) -> Encoder:
    """One encoder for each Python worker, in one thread as Spark gives each task one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end, plain) not in _encoders:
        _encoders[path, end, plain] = Encoder(path, end, plain=plain)
    return _encoders[path, end, plain]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of `docs` (doc_id, text) to `folder`.

    Ids are cut into ranges, a range into shards of about `shard_ids`, each a row of its task's file; within a range documents are
    in ascending doc_id order (null first; equal ids by the hash of their texts). A null text is
    empty, and an empty text is the end id alone. An added token's string in a text is that token, as
    the library's defaults have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end, plain=False)
        part, seq, held, docs_of, n = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            wm = WaveletMatrix.build(np.concatenate(held), encoder.bits)
            names, lengths = (pa.concat_arrays([x[k] for x in docs_of]) for k in (0, 1))
            cell = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), cell(names), cell(lengths), pa.array([wm.zeros], pa.list_(pa.int64())), pa.array([[p.tobytes() for p in wm.planes]], pa.list_(pa.binary())), pa.array([[r.astype("<u4").tobytes() for r in wm.ranks]], pa.list_(pa.binary()))],
                ["part", "seq", "n_ids", "doc_ids", "doc_lengths", "zeros", "planes", "ranks"],
            )

        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = sorted({0, len(parts), *(np.flatnonzero(np.diff(parts)) + 1).tolist(), *range(0, len(parts), Encoder.STEP)})
            for a, b in zip(edges, edges[1:], strict=False):
                if part is not None and (parts[a] != part or n >= shard_ids):
                    yield close()
                    seq, held, docs_of, n = (seq + 1 if parts[a] == part else 0), [], [], 0
                part = int(parts[a])
                ids, lengths = encoder.encode(batch.column("text").slice(a, b - a).to_pylist())
                held.append(ids)
                docs_of.append((batch.column("doc_id").slice(a, b - a), pa.array(lengths, pa.int64())))
                n += len(ids)
        if held:
            yield close()

    rows = by_ranges(docs.select("doc_id", "text"), "doc_id")
    rows = rows.repartition("part").sortWithinPartitions("part", "key", F.xxhash64("text")).select("part", "doc_id", "text")
    rows.mapInArrow(tidy(run, keep=True), _SHARD).write.option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids in all shards before each. Ranges are few, so their totals meet in one task."""
    slim = shards.select("part", "seq", "n_ids")
    whole = slim.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return slim.withColumn("own", own).join(whole.select("part", before.alias("before")), "part").select("part", "seq", (F.col("own") + F.col("before")).alias("shard_start"))


def decoded(shards: DataFrame) -> DataFrame:
    """(part, seq, doc_id, at, n_tokens, ids binary as little-endian uint32): the documents of each shard, from its planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                ids = WaveletMatrix.stored(row).ids().astype("<u4")
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - np.array(row["doc_lengths"], np.int64)
                for k in range(0, len(ends), 4096):
                    s, e = starts[k : k + 4096], ends[k : k + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * len(s), pa.int32()), pa.array([row["seq"]] * len(s), pa.int32()), pa.array(row["doc_ids"][k : k + 4096], pa.int64()), pa.array(s, pa.int64()), pa.array(e - s, pa.int64()), pa.array([ids[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary())],
                        ["part", "seq", "doc_id", "at", "n_tokens", "ids"],
                    )

    return shards.mapInArrow(tidy(run, keep=True), "part int, seq int, doc_id long, at long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the shards of `docs` and returns from them, one row per document: doc_id, start (ids
    of all documents before it), n_tokens (with the end id) and ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). An empty table writes nothing and gives no rows.
    """
    folder = folder or shared_dir(docs.sparkSession)
    write_shards(docs, folder, tokenizer, end)
    shards = read_shards(docs.sparkSession, folder)
    rows = decoded(shards).select("part", "seq", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def crc32(ids: np.ndarray) -> int:
    """The checksum of the query's ids_crc32, for tests."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
