from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quillspark.llm import importance as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, low, high):
    words = WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, low=1, high=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for table, into in ((docs, s), (target, t)):
        for _, text in table:
            into.update(map(bucket, features(text, low, high)[1]))
    total, other = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (other + buckets))))
    out = []
    for doc_id, text in docs:
        n, own = features(text, low, high)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return out


def plain(rows):
    return sorted(tuple(-(10**18) if v is None else v for v in r) for r in rows)


def frames(spark, docs, target):
    extra = ", chunk long, row long, features string, rank int, _part int, bucket string, score double"
    wide = [(*r, *[None] * 7) for r in docs]
    return spark.createDataFrame(wide, "doc_id long, text string" + extra).repartition(3), spark.createDataFrame([*target, (None, None)], "item_id long, text string")


DOCS = [
    *[(i, f"Alpha beta gamma{i % 7} été ÉTÉ 日本語 " * (i % 9) + "x1, y-2 _z_ Straße\u0000q") for i in range(60)],
    (3, "repeated id " * 15), (3, "repeated id " * 15), (None, "no id here " * 12), (None, None), (70, None), (71, ""), (72, " ,.;\t\n"), (73, "one " * 60_000), (74, "İI ıi ſ K"),
]
TARGET = [(1, "beta gamma3 gamma3"), (2, "日本語 new words one"), (3, "")]


@pytest.mark.parametrize(("low", "high", "percent", "least", "buckets"), [(1, 1, 10, 20, 10_000), (1, 3, 50, 1, 97), (2, 2, 100, 0, 10_000)])
def test_against_brute_force(spark, low, high, percent, least, buckets):
    docs, target = frames(spark, DOCS, TARGET)
    got = m.resample(docs, target, percent=percent, least=least, low=low, high=high, buckets=buckets).collect()
    want = brute(DOCS, TARGET, low, high, buckets, percent, least)
    assert plain(r[:5] for r in got) == plain(r[:5] for r in want)
    # of equal rows any may hold a rank of theirs
    assert plain((r["doc_id"], r["score"], r["rank"]) for r in got) == plain((r[0], r[4], r[5]) for r in want)


def test_small_chunks(spark, sf, monkeypatch):
    monkeypatch.setattr(m, "CHUNK_BYTES", 5_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    got = m.resample(docs, target).collect()
    assert plain(tuple(r) for r in got) == plain(brute([tuple(r) for r in docs.collect()], [tuple(r) for r in target.collect()]))


def test_empty_tables(spark):
    docs, target = frames(spark, DOCS[:25], TARGET)
    assert m.resample(docs.limit(0), target).collect() == []
    got = m.resample(docs, target.limit(0)).collect()
    assert plain(tuple(r) for r in got) == plain(brute(DOCS[:25], []))

