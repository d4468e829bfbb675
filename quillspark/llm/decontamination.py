"""Benchmark decontamination: CGK embedding and bit-sampling LSH, verified by exact edit distance.

Texts are compared as lower-case words with single blanks. An item within k edits of a window
leaves at least two of its k + 2 pieces intact, near their places; only the item-sized windows
around such pieces can match. From each of these pieces, wherever in the item it stands, a segment of
the window and of the item is embedded. The CGK random walk reads a string with a pointer that moves
on by a random bit for each step and byte, so a few edits change few of the walk's symbols; samples
of symbols from several walks are the keys. A window and an item are compared if a segment of one has
a key of the other's.

Items too short for that many pieces of eight bytes are cut into one piece more than the edits, so that one stands
intact wherever the item does; each window around one is compared at once, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, tidy

#: Bytes of a piece; shorter pieces are for items that don't have enough of these.
PIECE = 8
#: Walks, steps of each, samples from each walk, symbols in a sample.
WALKS, STEPS, SAMPLES, SYMBOLS = 8, 128, 5, 5
#: Bytes of items that a task holds at once; a larger benchmark takes a pass for each such block.
BLOCK = 16 << 20
_SEED = 11
_TABLE = bytearray(b" " * 256)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _TABLE[_b] = _b
for _b in range(65, 91):
    _TABLE[_b] = _b + 32
_TABLE = bytes(_TABLE)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    """Lower-case words (letters, digits and all beyond ASCII) with single blanks between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


def allowed(size: int, rate: float) -> int:
    """Edits at which an item of `size` bytes still matches: `rate` of it, but not all of its bytes."""
    return max(0, min(int(rate * size), size - 1))


def distance(item: bytes, window: bytes) -> int:
    """The smallest edit distance of `item` to any part of `window`, bit-parallel."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        best = min(best, score)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return best


def embed_keys(rows: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """(strings, WALKS * SAMPLES) keys of zero-padded byte rows: hashes of sampled CGK symbols."""
    n, width = rows.shape
    flat, base = np.ascontiguousarray(rows).ravel(), np.arange(n) * width
    r = np.random.default_rng(_SEED)
    keys = np.zeros((n, WALKS * SAMPLES), np.uint64)
    for walk in range(WALKS):
        bits = r.integers(0, 2, (STEPS, 256), np.int64)
        wanted = [np.sort(r.choice(STEPS, SYMBOLS, replace=False)) * steps // STEPS for _ in range(SAMPLES)]
        at = np.zeros(n, np.int64)
        for j in range(steps):
            c = np.where(at < width, flat[base + np.minimum(at, width - 1)], 0)
            for s, places in enumerate(wanted):
                if (hits := int((places == j).sum())):
                    k = walk * SAMPLES + s
                    for _ in range(hits):
                        keys[:, k] = (keys[:, k] ^ c.astype(np.uint64)) * _MIX + np.uint64(j + 1)
            at += bits[j][c]
        for s in range(SAMPLES):
            keys[:, walk * SAMPLES + s] += np.uint64((walk * SAMPLES + s + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    keys ^= keys >> np.uint64(31)
    return keys * _MIX


def _width(size: int) -> int:
    """Bytes of a segment that a walk sees: the largest power of two up to 64 in the `size` there are."""
    return min(64, 1 << (size.bit_length() - 1))


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)


class Pieces:
    """Which pieces the items have, and where: of 8 bytes and one more than leaves two intact where the item
    has room for them (two), else one more than the edits, of up to 8 bytes."""

    def __init__(self, items: list[bytes], rate: float):
        self.sizes = np.array([len(i) for i in items], np.int64)
        self.edits = np.array([allowed(len(i), rate) for i in items], np.int64)
        self.two = (self.edits + 2) * PIECE <= self.sizes
        grams, owner, place, widths = [], [], [], set()
        for n, item in enumerate(items):
            count = int(self.edits[n]) + 1 + bool(self.two[n])
            width = min(PIECE, len(item) // count)
            widths.add(width)
            for k in range(count):
                p = k * len(item) // count
                # no byte of an item is zero, so pieces of several widths are different numbers
                grams.append(int.from_bytes(item[p : p + width], "little"))
                owner.append(n)
                place.append(p)
        g = np.array(grams, np.uint64)
        order = np.argsort(g, kind="stable")
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.owner, self.place = np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.flag = np.zeros(1 << 20, bool)
        self.flag[self._slot(self.grams)] = True
        self.masks = [np.uint64((1 << 8 * w) - 1) for w in sorted(widths)]

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * _MIX) >> np.uint64(44)).astype(np.int64)

    def near(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, number among all pieces) of the pieces in `data` that have another piece of their item
        near its place, if it has two: no item-sized window without such pieces can be within the item's edits."""
        x = np.frombuffer(data + b"\0" * PIECE, np.uint8)
        hits = []
        for off in range(PIECE):
            n = (len(x) - off) // PIECE
            if n > 0 and len(self.grams):
                whole = x[off : off + n * PIECE].view(np.uint64)
                for mask in self.masks:
                    g = whole & mask
                    at = np.flatnonzero(self.flag[self._slot(g)])
                    k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
                    good = self.grams[k] == g[at]
                    hits.append(np.stack([at[good] * PIECE + off, k[good]]))
        if not hits or not sum(h.shape[1] for h in hits):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, k = np.concatenate(hits, axis=1)
        n = self.count[k]
        post = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        order = np.lexsort((self.place[post], at - self.place[post], self.owner[post]))
        at, post = at[order], post[order]
        owner, place, diagonal = self.owner[post], self.place[post], at - self.place[post]
        # another piece of the item on a diagonal within its edits: a neighbour in this order, but for the same piece again
        near = ~self.two[owner]
        step, open_ = 1, np.flatnonzero(~near)
        while len(open_):
            open_ = open_[open_ + step < len(owner)]
            other = open_ + step
            inside = (owner[open_] == owner[other]) & (diagonal[other] - diagonal[open_] <= self.edits[owner[open_]])
            open_, other = open_[inside], other[inside]
            two = place[open_] != place[other]
            near[open_[two]] = near[other[two]] = True
            open_ = open_[~two]  # the same piece again: look further
            step += 1
        return at[near], post[near]

    def starts(self, data: bytes) -> np.ndarray:
        """(place, number of the item) for the word starts at which an item with such pieces can begin."""
        at, post = self.near(data)
        owner, diagonal, x = self.owner[post], at - self.place[post], np.frombuffer(data, np.uint8)
        words = np.concatenate([[0], np.flatnonzero((x[:-1] == 32) | (x[:-1] == 10)) + 1]) if len(x) else np.zeros(0, np.int64)
        low, high = np.searchsorted(words, diagonal - self.edits[owner]), np.searchsorted(words, diagonal + self.edits[owner], "right")
        n = high - low
        place = words[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return np.unique(np.stack([place, np.repeat(owner, n)], 1), axis=0)


class Finder:
    """Finds the items in plain texts: pieces, then keys, then the edit distance."""

    def __init__(self, items: list[bytes], rate: float):
        self.items, self.pieces = items, Pieces(items, rate)
        before, after = self.pieces.place + PIECE, self.pieces.sizes[self.pieces.owner] - self.pieces.place
        #: a piece's segment goes to the side where its item has more bytes; backward it is read from its end
        self.back = before > after
        self.width = np.array([_width(n) for n in np.maximum(before, after).tolist()], np.int64)
        self.keys = np.zeros((len(before), WALKS * SAMPLES), np.uint64)  # of pieces that a text had
        self.known = np.zeros(len(before), bool)

    def _embed(self, strings: list[bytes], width: int) -> np.ndarray:
        return np.concatenate([embed_keys(_padded(strings[i : i + 8192], width), 2 * width) for i in range(0, len(strings), 8192)])

    def _alike(self, data: bytes, at: np.ndarray, post: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the segments from pieces at places `at`, between `low` and `high`, share a key with their items'."""
        out = np.zeros(len(at), bool)
        for w in np.unique(self.width[post]).tolist():
            for back in (False, True):
                own = np.flatnonzero((self.width[post] == w) & (self.back[post] == back))
                if not len(own):
                    continue
                segment = lambda text, p, a, e: text[max(a, p + PIECE - w) : p + PIECE][::-1] if back else text[p : min(p + w, e)]  # noqa: B023, E731
                new = np.unique(post[own])
                new = new[~self.known[new]]
                if len(new):
                    parts = zip(self.pieces.owner[new].tolist(), self.pieces.place[new].tolist(), strict=True)
                    self.keys[new] = self._embed([segment(self.items[n], p, 0, len(self.items[n])) for n, p in parts], w)
                    self.known[new] = True
                places, first, nth = np.unique(at[own], return_index=True, return_inverse=True)
                parts = zip(places.tolist(), low[own][first].tolist(), high[own][first].tolist(), strict=True)
                keys = self._embed([segment(data, p, a, e) for p, a, e in parts], w)
                for i in range(0, len(own), 8192):
                    some = own[i : i + 8192]
                    out[some] = (keys[nth[i : i + 8192]] == self.keys[post[some]]).any(1)
        return out

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(number of the text, number of the item, edits) of all matches, with the fewest edits each."""
        data = b"\n".join(texts) + b"\n"
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        at, post = self.pieces.near(data)
        doc = np.searchsorted(begins, at, "right") - 1
        low, high = begins[doc], begins[doc] + np.array([len(t) for t in texts], np.int64)[doc]
        alike = ~self.pieces.two[self.pieces.owner[post]]
        far = np.flatnonzero(~alike)
        alike[far] = self._alike(data, at[far], post[far], low[far], high[far])
        own = np.flatnonzero(alike)
        owner = self.pieces.owner[post[own]]
        start, most, size = at[own] - self.pieces.place[post[own]], self.pieces.edits[owner], self.pieces.sizes[owner]
        low, high = np.maximum(low[own], start - most), np.minimum(high[own], start + size + most)
        order = np.lexsort((low, owner, doc[own]))
        best: dict[tuple[int, int], int] = {}
        windows: list[list[int]] = []  # windows of an item that overlap are compared as one
        for d, n, s, e in zip(doc[own][order].tolist(), owner[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True):
            if windows and windows[-1][:2] == [d, n] and s <= windows[-1][3]:
                windows[-1][3] = max(windows[-1][3], e)
            else:
                windows.append([d, n, s, e])
        for d, n, s, e in windows:
            item, most = self.items[n], int(self.pieces.edits[n])
            if best.get((d, n), most + 1):
                edits = 0 if data.find(item, s, e) >= 0 else distance(item, data[s:e])
                if edits <= most:
                    best[d, n] = min(edits, best.get((d, n), edits))
        return [(d, n, edits) for (d, n), edits in best.items()]


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block: int | None = None) -> DataFrame:
    """(doc_id, item_id, edits, item_size): each row of `docs` (doc_id, text) in which an item of
    `benchmark` (item_id, text) stands within `rate` of its size in edits, with the fewest edits.

    Case, punctuation and white space don't count. Edits are bytes of the plain texts. A short item may
    stand within a word. Items with a null id or without letters or digits match nothing; null and empty texts hold nothing. Equal items
    each match; repeated rows each match; an empty table gives no rows. Items are read in blocks of
    `block` bytes (BLOCK, if not given), and each block takes a pass over the documents, without a shuffle.
    """
    found, held, size = None, [], 0

    def add(found: DataFrame | None, last: bool) -> DataFrame:
        one = _block(docs, [i for i, _ in held], [t for _, t in held], rate)
        # with several blocks, each is searched for at once, so that the driver holds one alone
        one = one if last and found is None else cut(one)
        return one if found is None else found.unionByName(one)

    for r in benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = plain(r["text"])
        if text:
            if size + len(text) > (block or BLOCK) and held:
                found, held, size = add(found, False), [], 0
            size += len(text)
            held.append((r["item_id"], text))
    return add(found, True)


def _block(docs: DataFrame, item_ids: list[int], items: list[bytes], rate: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(items, rate)
        for b in batches:
            out, k = [], 0
            ids = b["doc_id"].to_numpy(object)
            while k < len(b) and items:
                held, size, first = [], 0, k
                while k < len(b) and (not held or size < 1 << 20):  # about a megabyte of text at a time
                    held.append(plain(b["text"].iloc[k]))
                    size += len(held[-1]) + 1
                    k += 1
                out += [(ids[first + d], item_ids[n], edits, len(items[n])) for d, n, edits in finder.find(held)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits", "item_size"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(tidy(run), "doc_id long, item_id long, edits int, item_size int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """`docs` (doc_id, text, more) without the documents that hold an item of `benchmark` (item_id, text).

    A row with a null doc_id stays, as do null and empty texts; all rows with a doc_id go if one of them holds
    an item. Repeated rows stay or go alike. Without items all stay; an empty table gives no rows.
    """
    found = cut(leaks(docs, benchmark, rate).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti")
