from __future__ import annotations

import random

import numpy as np
import pytest

from quillspark.llm import decontamination as d


def naive(item: bytes, window: bytes) -> int:
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def edited(r, text, n):
    for _ in range(n):
        k = r.randrange(1, len(text) - 1)
        kind = r.randrange(3)
        text = text[:k] + (r.choice("uvwxyz") if kind else "") + text[k + (kind != 2) :]
    return text


def test_distance_is_the_naive_one():
    r = random.Random(1)
    for _ in range(60):
        a, b = words(r, r.randint(1, 12)).encode(), words(r, r.randint(0, 12)).encode()
        assert d.distance(a, b) == naive(a, b)
        assert d.distance(a, b + a + b) == 0


def test_recall_against_brute_force(spark):
    """Items with up to nine edits in a hundred, at any place of a document, are found; clean documents aren't."""
    r = random.Random(7)
    items = [(n, words(r, r.randint(14, 45))) for n in range(40)]
    docs, want = [], set()
    for n in range(300):
        text = words(r, r.randint(30, 200)).split()
        if n % 2:
            i, item = items[n % 40]
            size = len(d.plain(item))
            inside = edited(r, item, r.randint(0, int(0.09 * size)))
            k = r.randrange(len(text))
            text[k:k] = [inside.title() if n % 3 else inside.replace(" ", "\n", 1)]
        docs.append((n, " ".join(text)))
        for i, item in items:
            p = d.plain(item)
            if i == n % 40 and naive(p, d.plain(docs[-1][1])) <= d.allowed(len(p), 0.1):
                want.add((n, i))
    found = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]) for x in found}
    assert len(want) > 140 and len(got & want) >= 0.97 * len(want)
    for x in found:
        p = d.plain(items[x["item_id"]][1])
        assert x["edits"] == naive(p, d.plain(docs[x["doc_id"]][1])) <= d.allowed(len(p), 0.1)


def test_pieces_lose_no_window():
    """Wherever an item stands within its edits, its word start is among the places."""
    r = random.Random(3)
    for _ in range(40):
        item = d.plain(words(r, 30))
        pieces = d.Pieces([item], 0.1)
        before = d.plain(words(r, 20))
        data = before + b" " + edited(r, item.decode(), int(pieces.edits[0])).encode() + b" " + d.plain(words(r, 5)) + b"\n"
        if naive(item, data) <= pieces.edits[0]:
            assert len(before) + 1 in pieces.starts(data)[:, 0]


def test_equal_strings_share_all_keys():
    rows = np.frombuffer(b"".join(s.ljust(64, b"\0") for s in (b"abc def", b"abc def", b"abc deg")), np.uint8).reshape(3, 64)
    k = d.embed_keys(rows)
    assert (k[0] == k[1]).all() and (k[0] != k[2]).any()


def test_decontaminate_keeps_the_rest(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    docs = spark.createDataFrame([(1, f"x {item.upper()}! y", 0), (2, "nothing here", 1), (3, None, 2), (None, item, 3), (4, "", 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, "short"), (None, "nothing here at all, but it has no id at all"), (3, None)], "item_id long, text string")
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [1, 2, 3, 4]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 100)
    r = random.Random(9)
    items = [(n, words(r, 20)) for n in range(6)]
    docs = spark.createDataFrame([(n, f"a {t} b") for n, t in items], "doc_id long, text string")
    found = d.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["item_id"], x["edits"]) for x in found) == [(n, n, 0) for n in range(6)]


def test_recall_where_edits_are_packed():
    """Edits that stand together at the head, in the middle or at the tail lose no item, nor do edits of words without blanks."""
    r = random.Random(21)
    for blank in (" ", ""):
        items = [d.plain(words(r, 60).replace(" ", blank))[:233] for _ in range(60)]
        finder = d.Finder(items, 0.1)
        for where in (range(64), range(84, 148), range(169, 233), range(233)):
            texts = []
            for item in items:
                inside = bytearray(item)
                for k in r.sample(where, 20):
                    inside[k] = r.choice(b"uvwxyz")
                texts.append(d.plain(words(r, 20)) + blank.encode() + bytes(inside) + blank.encode() + d.plain(words(r, 20)))
            found = {(a, b): edits for a, b, edits in finder.find(texts)}
            assert sum((n, n) in found for n in range(60)) >= 59, (blank, where)
            assert all(edits == naive(items[b], texts[a]) for (a, b), edits in list(found.items())[:5])


@pytest.mark.parametrize("size", [40, 200, 1000, 5000])
def test_recall_by_size_and_place_of_edits(size):
    """At each size, edits spread evenly, at the head, at the tail or in one burst lose less than a tenth of the items."""
    r = random.Random(size)
    count = 40 if size < 1000 else 10
    items = [d.plain(words(r, size // 4))[:size].strip() for _ in range(count)]
    finder = d.Finder(items, 0.1)
    for kind in ("even", "head", "tail", "burst"):
        texts = []
        for item in items:
            inside, edits = bytearray(item), d.allowed(len(item), 0.1)
            middle = r.randrange(len(item) - 2 * edits)
            where = {"even": range(len(item)), "head": range(2 * edits), "tail": range(len(item) - 2 * edits, len(item)), "burst": range(middle, middle + 2 * edits)}[kind]
            for k in sorted(r.sample(where, edits), reverse=True):
                if r.random() < 0.6:
                    inside[k] = r.choice(b"uvwxyz")
                elif len(inside) % 2:
                    del inside[k]
                else:
                    inside.insert(k, r.choice(b"uvwxyz"))
            texts.append(d.plain(words(r, 20)) + b" " + bytes(inside) + b" " + d.plain(words(r, 20)))
        found = {(a, b) for a, b, _ in finder.find(texts)}
        assert sum((n, n) in found for n in range(count)) >= 0.9 * count, kind


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a text of some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, none).count() == 0 and d.decontaminate(docs, none).count() == 1


@pytest.mark.parametrize("size", [1, 5, 9, 12, 20, 28, 40, 60, 79, 80])
def test_short_items_by_distance_alone(size):
    """Short items are found wherever a part of the text is within a tenth of their size, and nowhere else."""
    r = random.Random(size)
    items = [i for i in {d.plain(words(r, size))[:size].strip() for _ in range(60)} if len(i) == size]
    finder, texts = d.Finder(items, 0.1), []
    for kind in ("even", "head", "tail"):
        for item in items:
            inside, edits = bytearray(item), int(0.1 * size)
            where = {"even": range(size), "head": range(2 * edits), "tail": range(size - 2 * edits, size)}[kind]
            for k in sorted(r.sample(where, edits), reverse=True):
                if r.random() < 0.6:
                    inside[k] = r.choice(b"uvwxyz")
                elif r.random() < 0.5:
                    del inside[k]
                else:
                    inside.insert(k, r.choice(b"uvwxyz"))
            texts.append(d.plain(words(r, 6)) + b" " + bytes(inside) + b" " + d.plain(words(r, 6)))
    want = {(a, b): e for a, t in enumerate(texts) for b, i in enumerate(items) if (e := d.distance(i, t)) <= int(0.1 * size)}
    got = {(a, b): e for a, b, e in finder.find(texts)}
    assert all((k * len(items) + n, n) in want for k in range(3) for n in range(len(items)))
    if size < 80:
        assert got == want
    else:
        assert got.items() <= want.items() and len(got) >= 0.9 * len(want)


def test_items_of_all_sizes_together():
    """Short and long items in one search: pieces of several widths don't take each other's places."""
    r = random.Random(77)
    items = [d.plain(words(r, 60))[:n].strip() for n in (3, 7, 15, 16, 33, 47, 64, 90, 150) for _ in range(4)]
    texts = [d.plain(words(r, 8)) + b" " + i + b" " + d.plain(words(r, 3)) for i in items] + [b"", items[0], items[-1]]
    got = {(a, b): e for a, b, e in d.Finder(items, 0.1).find(texts)}
    want = {(a, b): e for a, t in enumerate(texts) for b, i in enumerate(items) if t and (e := d.distance(i, t)) <= int(0.1 * len(i))}
    assert got == want and len(want) >= len(items) + 2
