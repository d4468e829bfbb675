"""Byte-level BPE by speculation: propose the longest tokens, verify every pair of neighbours, merge only what fails.

A sequence of tokens is what merging gives exactly if each token is what its own bytes merge to and no pair
of neighbours would have been merged otherwise: undoing the latest merges on both sides of a boundary,
latest first, must never lay bare a pair whose merge has an earlier rank than what was undone. Whole batches
of pairs are undone at once, so the proof costs a few array steps; words with a pair that fails are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import HELD, tidy
from quillspark.llm.token_files import _BYTE_LETTERS, _PRINTED, Encoder

# Fixed value: the pattern by which byte-level BPE cuts texts into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTER_BYTES = {chr(b): b for b in _PRINTED} | {chr(c): b for b, c in _BYTE_LETTERS.items()}
_NEVER = np.int64(1 << 40)
#: Ends a text among words; a control character and a letter are never one piece.
END = "\1a"


class Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library's file format, as arrays over ids.

    `rank` is the rank of the merge that makes a token (-1: a byte), `left` and `right` what it merges.
    `whole` tells the tokens that their own bytes merge to; only these are proposed.
    """

    #: Bytes of a piece that is merged together with others, at most.
    SHORT = 48

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model, kinds = own["model"], [own["pre_tokenizer"], own["decoder"]]
        if own["normalizer"] or model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or any(k["type"] != "ByteLevel" for k in kinds) or own["pre_tokenizer"]["add_prefix_space"] or not own["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        names = model["vocab"]
        self.added = {t["content"]: t["id"] for t in own["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in own["added_tokens"]):
            raise ValueError("added tokens that take more than their own string")
        size = 1 + max([*names.values(), *self.added.values()])
        self.bytes = [b""] * size
        for name, i in names.items():
            self.bytes[i] = bytes(map(_LETTER_BYTES.__getitem__, name))
        for name, i in self.added.items():
            self.bytes[i] = name.encode()
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.byte_id = [names[chr(_BYTE_LETTERS.get(b, b))] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, pair = names[a + b], (names[a], names[b])
            self.merges[pair] = rank, i
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = rank, *pair
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks, self.size = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order], size
        self.made = np.array([i for _, i in self.merges.values()], np.int64)
        made = np.flatnonzero(self.rank >= 0)
        self.whole = np.zeros(size, bool)
        self.whole[self.byte_id] = True
        self.whole[made[self.compatible(self.left[made], self.right[made], self.rank[made])]] = True
        # a token is made of tokens that hold too; these have earlier ranks
        for i in made[np.argsort(self.rank[made])]:
            self.whole[i] &= self.whole[self.left[i]] and self.whole[self.right[i]]
        self.proposed = {self.bytes[i]: i for i in np.flatnonzero(self.whole).tolist()}
        self._trie()

    def _trie(self) -> None:
        """Beginnings of the proposed tokens as numbered nodes: `edges` has node * 256 + byte, in order, `below` the
        node it leads to, `ends` the token that a node is, or -1."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: dict[int, int] = {}
        for token in self.proposed:
            for n in range(1, len(token) + 1):
                if token[:n] not in nodes:
                    edges[nodes[token[: n - 1]] << 8 | token[n - 1]] = nodes[token[:n]] = len(nodes)
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edges, self.below = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.ends = np.array([self.proposed.get(t, -1) for t in nodes], np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which a and b merge; none: later than all."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens of each pair stay as they are side by side. With `until`, merges of that
        rank and later at the boundary don't count."""
        good = np.ones(len(left), bool)
        live, a, b = np.arange(len(left)), np.asarray(left, np.int64), np.asarray(right, np.int64)
        limit = np.full(len(live), _NEVER) if until is None else np.asarray(until, np.int64)
        while len(live):
            clash = self._pair_rank(a, b) < limit
            good[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # the later merge is undone first; of two of one rank the right one came later
            first = ra > rb
            limit = np.where(first, ra, rb + 1)  # one at the left of an equal merge comes before it
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of a piece by merging: the earliest rank first, of equal ones the leftmost."""
        ids: list[int] = [self.byte_id[x] for x in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        found = self.merges.get
        heap = [(hit[0], k, hit[1], ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (hit := found((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n >= len(ids) or ids[n] != b:
                continue  # one of the two is merged already
            ids[k], ids[n], after[k] = new, -1, after[n]
            if after[k] < len(ids):
                before[after[k]] = k
                if hit := found((new, ids[after[k]])):
                    heapq.heappush(heap, (hit[0], k, hit[1], new, ids[after[k]]))
            if before[k] >= 0 and (hit := found((ids[before[k]], new))):
                heapq.heappush(heap, (hit[0], before[k], hit[1], ids[before[k]], new))
        return [i for i in ids if i >= 0]

    def merged_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`merged` of many short pieces at once, and their numbers of tokens: each round does one merge in each
        piece that has one left."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), sizes)
        last = np.append(of[1:] != of[:-1], True)
        rank = np.full(len(ids), _NEVER)
        rank[:-1] = self._pair_rank(ids[:-1], ids[1:])
        rank[last] = _NEVER
        starts = np.cumsum(sizes) - sizes
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            least = np.minimum.reduceat(rank, starts)
            over = least == _NEVER
            if over.any():
                # pieces without a merge left are taken out
                gone = np.repeat(over, np.diff(starts, append=len(ids)))
                done.append((of[gone], ids[gone]))
                ids, of, rank, least = ids[~gone], of[~gone], rank[~gone], least[~over]
                if not len(ids):
                    break
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            hits = np.flatnonzero(rank == np.repeat(least, np.diff(starts, append=len(ids))))
            at = hits[np.append(True, of[hits[1:]] != of[hits[:-1]])]  # the leftmost of each piece
            ids[at] = self.made[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # as many ids before it are gone as there are pieces before its own
            ids, of, rank = ids[keep], of[keep], rank[keep]
            starts = starts - np.arange(len(starts))
            for k in (at, at[at > 0] - 1):
                b = np.minimum(k + 1, len(ids) - 1)
                rank[k] = np.where((b > k) & (of[b] == of[k]), self._pair_rank(ids[k], ids[b]), _NEVER)
        of, ids = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(pieces))

    def proposals(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each place of each piece, from the left, and the pieces' numbers of tokens. All
        pieces walk the tokens' beginnings side by side."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        own = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
        stop = np.cumsum(sizes)
        at, of, found = stop - sizes, np.arange(len(pieces)), []
        while len(of):
            live, node, place = np.arange(len(of)), np.zeros(len(of), np.int64), at.copy()
            token, end = np.full(len(of), -1), at.copy()
            while len(live):
                key = node << 8 | own[place]
                k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                go = (self.edges[k] == key) & (place < stop[of[live]])
                live, node, place = live[go], self.below[k[go]], place[go] + 1
                hit = self.ends[node] >= 0
                token[live[hit]], end[live[hit]] = self.ends[node[hit]], place[hit]
            found.append((of, token))
            more = end < stop[of]
            of, at = of[more], end[more]
        of, token = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        return token[order], np.bincount(of, minlength=len(pieces))

    def encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, none empty, and their numbers: proposals, and exact merging where two
        neighbours of one don't hold."""
        flat, sizes = self.proposals(pieces)
        of = np.repeat(np.arange(len(pieces)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1])
        pairs, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[which]
        failed = np.unique(of[inner[~good]])
        if not len(failed):
            return flat, sizes
        texts = [pieces[k] for k in failed.tolist()]
        long = np.array([len(t) > self.SHORT for t in texts])
        short, n = self.merged_together([t for t in texts if len(t) <= self.SHORT])
        again = [self.merged(t) for t in texts if len(t) > self.SHORT]
        # all tokens by their piece, in order
        kept = ~np.isin(of, failed)
        of = np.concatenate([of[kept], np.repeat(failed[~long], n), np.repeat(failed[long], [len(x) for x in again])])
        flat = np.concatenate([flat[kept], short, np.array([i for x in again for i in x], np.int64)])
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(pieces))


class Speculator:
    """Texts to ids and back. Each distinct word of a batch is looked up once in a table of words, which
    starts anew when it holds `kept` of them; words that aren't there are encoded together."""

    #: Words of more letters aren't kept, and a batch is cut where its texts pass so many letters.
    LONGEST, LETTERS = 40, 1 << 21

    def __init__(self, path: str, kept: int = 300_000):
        self.vocabulary, self.kept, self.cut = Vocabulary(path), kept, regex.compile(PIECES)
        self.added = regex.compile("|".join(sorted(map(regex.escape, self.vocabulary.added), key=len, reverse=True)) or r"(?!)")
        cells = self.vocabulary.bytes
        self.letters, self.starts = np.frombuffer(b"".join(cells), np.uint8), np.cumsum([0, *map(len, cells)])
        self._clear()

    def _clear(self) -> None:
        """A table of the end of a text alone, which has no ids."""
        self.index, self.ids, self.first, self.size = {END: 0}, array("i"), array("q", [0]), array("q", [0])

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words and each one's number of ids. Letters alone, with a blank before them or not, are one
        piece; other words are cut. All pieces are encoded together."""
        pieces, n = [], np.ones(len(words), np.int64)
        for k, w in enumerate(words):
            if (w[1:] if w[0] == " " else w).isalpha():
                pieces.append(w.encode())
            else:
                own = self.cut.findall(w)
                n[k] = len(own)
                pieces += [p.encode() for p in own]
        ids, sizes = self.vocabulary.encoded(pieces)
        return ids, np.add.reduceat(sizes, np.cumsum(n) - n) if len(words) else sizes

    def _pieces(self, text: str) -> list[list[str] | int]:
        """A text of any kind: the words between added tokens, and these tokens' ids."""
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self.cut.findall(text[at : m.start()]), self.vocabulary.added[m[0]]]
            at = m.end()
        return [*out, self.cut.findall(text[at:])]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's number of ids.

        A text of regular white space is cut before blanks, line ends and marks after a letter or digit, which no
        piece goes across; any other by the pattern. Either way its words are coded by the batch's dictionary.
        """
        lines, odd = [], []
        for n, text in enumerate(texts):
            if text and Encoder._regular(text) and not self.added.search(text):
                lines.append(f"{Encoder._marked(text)}\0{END}\0")
            else:
                lines.append(f"{END}\0")
                if text:
                    odd.append((n, self._pieces(text)))
        whole = "".join(lines).replace(" ", "\0 ").replace("\n", "\0\n\0")
        words = pc.split_pattern(pa.array([whole], pa.large_string()), "\0").flatten()
        words = words.slice(0, len(words) - 1)
        strange = pa.array([w for _, parts in odd for p in parts if not isinstance(p, int) for w in p], pa.large_string())
        coded = pa.concat_arrays([words, strange]).dictionary_encode()
        own, had = coded.dictionary.to_pylist(), len(self.first)
        row = np.fromiter(map(self.index.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(row < 0)
        row[new] = np.arange(had, had + len(new))
        ids, sizes = self._new([own[k] for k in new.tolist()])
        # added tokens are rows of their own after the new words
        marks = sorted({p for _, parts in odd for p in parts if isinstance(p, int)})
        for values, sized in ((ids, sizes), (np.array(marks, np.int64), np.ones(len(marks), np.int64))):
            self.first.frombytes((len(self.ids) + np.cumsum(sized) - sized).astype(np.int64).tobytes())
            self.size.frombytes(sized.astype(np.int64).tobytes())
            self.ids.frombytes(values.astype(np.int32).tobytes())
        places = row[coded.indices.to_numpy()]
        if odd:
            places = self._spliced(places[: len(words)], places[len(words) :], odd, {i: had + len(new) + k for k, i in enumerate(marks)})
        flat, first, size = (np.frombuffer(x, t) for x, t in ((self.ids, np.int32), (self.first, np.int64), (self.size, np.int64)))
        n = size[places]
        take = np.repeat(first[places] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out = flat[take], np.diff(np.cumsum(n)[places == 0], prepend=0)
        del flat, first, size  # the tables can't grow while they are looked at
        if len(self.first) > self.kept:
            self._clear()
        else:
            self.index.update((own[k], int(r)) for k, r in zip(new.tolist(), row[new].tolist(), strict=True) if len(own[k]) <= self.LONGEST)
        return out

    @staticmethod
    def _spliced(places: np.ndarray, strange: np.ndarray, odd: list, marks: dict[int, int]) -> np.ndarray:
        """The texts' words with those of odd texts where these stand: before their ends."""
        ends, out, at, used = np.flatnonzero(places == 0), [], 0, 0
        for n, parts in odd:
            out.append(places[at : ends[n]])
            at = ends[n]
            for p in parts:
                if isinstance(p, int):
                    out.append(np.array([marks[p]]))
                else:
                    out.append(strange[used : used + len(p)])
                    used += len(p)
        return np.concatenate([*out, places[at:]])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts that stand for the ids; bytes that are no UTF-8 become U+FFFD."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < self.vocabulary.size:
            raise ValueError("an id beyond the vocabulary")
        n = self.starts[ids + 1] - self.starts[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(self.starts[ids] - ends[:-1], n) + np.arange(ends[-1])
        held, at, out = self.letters[take].tobytes(), 0, []
        ends = ends[np.cumsum(lengths)]
        for e in ends.tolist():
            out.append(held[at:e].decode("utf-8", "replace"))
            at = e
        return out


_speculators: dict[str, Speculator] = {}
HELD.append(_speculators)


def _speculator(path: str) -> Speculator:
    """One for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _speculators:
        _speculators[path] = Speculator(path)
    return _speculators[path]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to `most` at most, or of one row."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>): `docs` (doc_id, text) as the tokenizers library encodes them with the file
    `tokenizer` and add_special_tokens=False. An added token's string in a text is that token. A null
    text is empty, an empty text has no ids; repeated rows and null ids stay; other columns don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _speculator(tokenizer)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for a, b in _slices(sizes, Speculator.LETTERS):
                ids, lengths = own.encode(batch.column("text").slice(a, b - a).to_pylist())
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, keep=True), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids): what the library's decode(ids, skip_special_tokens=False)
    gives. Null ids are none; an id beyond the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _speculator(tokenizer)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy()
            for a, b in _slices(sizes, Speculator.LETTERS):
                ids = batch.column("ids").slice(a, b - a)
                texts = own.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(tidy(run, keep=True), "doc_id long, ids array<int>, text string")
