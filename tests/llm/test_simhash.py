from __future__ import annotations

import itertools
import random

import xxhash

from quillspark.llm import fingerprints, simhash_dedup
from quillspark.llm.common import components


def naive(text, width=4):
    words = [w for w in (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def union_find(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def near(n, seed, most):
    """Fingerprints of which many are within a few bits of each other."""
    r = random.Random(seed)
    out = {0}
    while len(out) < n:
        f = r.getrandbits(64) if r.random() < 0.4 else r.choice(sorted(out))
        for _ in range(r.randint(0, most)):
            f ^= 1 << r.randrange(64)
        out.add(f)
    return sorted(f - (1 << 64) if f >> 63 else f for f in out)


def test_simhash_is_the_naive_one(spark, sf):
    texts = ["", None, "one", "A b C", "a b c d", "É x y z w q", "x\x1cy z a b c", "  t\tu\nv\x0bw\x0cx\ry  ", *[r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]]
    for t in texts:
        assert simhash_dedup.simhash(t) == naive(t)


def test_fingerprint_is_sparks_xxhash64(spark):
    t = "the quick brown fox jumps"
    row = spark.sql("select xxhash64('the quick brown fox') a, xxhash64('quick brown fox jumps') b").first()
    both = [row["a"] % (1 << 64), row["b"] % (1 << 64)]
    assert simhash_dedup.simhash(t) == both[0] & both[1]


def test_links_are_all_pairs(spark):
    fps = near(400, 3, 5)
    rows = spark.createDataFrame([(f, n) for n, f in enumerate(fps)], "fp long, rep long")
    got = sorted(tuple(sorted(r)) for r in simhash_dedup.links(rows, 4).collect())
    want = sorted((i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert got == want and len(want) > 100


def test_spanning_links_join_the_same_components(spark):
    """Links are true ones, and components are those of all pairs, in clusters and chains of any density."""
    for n, seed, most in ((400, 3, 5), (300, 5, 2), (300, 6, 8), (500, 8, 1)):
        fps = near(n, seed, most)
        rows = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long")
        got = {tuple(sorted(r)) for r in simhash_dedup.spanning_links(rows, 4).collect()}
        want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
        assert got <= want and union_find(range(len(fps)), got) == union_find(range(len(fps)), want)


def test_dense_cluster_makes_few_links(spark):
    """All 2,081 fingerprints within two bits of one: 2,164,240 pairs, but links in proportion to the fingerprints."""
    middle = 0x5DEECE66D1234567
    fps = [middle] + [middle ^ 1 << i for i in range(64)] + [middle ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f, n) for n, f in enumerate(signed)], "fp long, rep long")
    found = simhash_dedup.spanning_links(rows, 4)
    got = {tuple(sorted(r)) for r in found.collect()}
    assert len(fps) == 2081 and len(got) < 16000
    assert set(union_find(range(2081), got).values()) == {0}


def test_permuted_tables_are_all_pairs(spark):
    fps = near(400, 4, 4)
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = sorted(tuple(sorted(r)) for r in fingerprints.links(rows, 3).collect())
    want = sorted((a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert got == want and len(want) > 50


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == union_find(nodes, links)


def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {d: naive(t) for d, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = union_find(fps, links)
    rows = simhash_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    dense = simhash_dedup.near_duplicates(docs, dense=True).collect()
    assert {tuple(r) for r in dense} == {tuple(r) for r in rows}
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def brute(text):
    import re

    words = re.split(r"[\x20\x09-\x0D]+", text.lower())
    votes, whole = [0] * 64, 0
    for a, b in itertools.zip_longest(words, words[1:]):
        h = xxhash.xxh64(a.encode(), seed=42).intdigest()
        h = h if b is None else xxhash.xxh64(b.encode(), seed=h).intdigest()
        w = len(a) + len(b or "")
        whole += w
        for k in range(64):
            votes[k] += w * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > whole)


def test_document_fingerprints_against_brute_force(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    rows = {r["doc_id"]: r for r in fingerprints.document_fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    for k, (doc_id, text) in enumerate(texts):
        other, r = texts[(k + 1) % len(texts)][1], rows[doc_id]
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        f, e, n = brute(text), brute(edited), brute(other)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}")
        assert abs(r["near_edited"] - (1 - (f ^ e).bit_count() / 64)) < 1e-12 and abs(r["near_next"] - (1 - (f ^ n).bit_count() / 64)) < 1e-12
    near_edited = [r["near_edited"] for r in rows.values()]
    assert sum(near_edited) / len(near_edited) > 0.7
    for r in rows.values():
        want = {x["fingerprint"] for x in rows.values() if 0 < (int(x["fingerprint"], 16) ^ int(r["fingerprint"], 16)).bit_count() <= 3}
        assert r["n_links"] == len(want)
