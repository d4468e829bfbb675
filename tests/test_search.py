from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.operators import discover, graph, lexical, metrics, search


def ranked(spark, *lists):
    return {name: spark.createDataFrame([(1, str(k), 0, n) for n, k in enumerate(own)], "query_id long, note_path string, seq int, rank int") for name, own in zip(("bm25", "vector"), lists, strict=True)}


def test_fusion(spark):
    r = random.Random(8)
    for n in (0, 1, 6, 15):
        a, b = (r.sample(range(100, 118), k=min(n, 15)) for _ in range(2))
        got = search.fuse(ranked(spark, a, b)).orderBy(*search.fused_order()).collect()
        score = lambda k: sum(1 / (60 + own.index(k) + 1) for own in (a, b) if k in own)  # noqa: E731, B023
        want = sorted({*a, *b}, key=lambda k: (-round(score(k), 12), b.index(k) if k in b else 99, str(k)))  # noqa: B023
        assert [r["note_path"] for r in got] == [str(k) for k in want]
        assert [r["score"] for r in got] == pytest.approx([score(k) for k in want])


def test_pools():
    assert (search.note_pool(10), search.note_pool(1), search.passage_pool(10), search.pool(1 << 40)) == (150, 30, 60, 2147483647)


def test_bm25_against_fts5(spark):
    r = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "relational", "running", "notes"]
    texts = [" ".join(r.choices(vocabulary, weights=range(8, 0, -1), k=r.randint(3, 30))) for _ in range(31)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, x) VALUES (?, ?)", list(enumerate(texts, 1)))
    chunks = spark.createDataFrame([("n", k, x) for k, x in enumerate(texts, 1)], "note_path string, seq int, text string")
    postings, stats = lexical.index(chunks, stem=True)
    asked = ["alpha notes", "omega omega run", "relation", "missing", "beta gamma delta"]
    words = lexical.query_words(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), stem=True)
    got = {}
    for row in lexical.bm25(postings, stats, words).collect():
        got.setdefault(row["query_id"], {})[row["seq"]] = row["score"]
    for n, q in enumerate(asked):
        match = " OR ".join(f'"{w}"' for w in q.split())
        want = {row: -rank for row, rank in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
        assert got.get(n, {}).keys() == want.keys()
        assert all(abs(got[n][k] - v) < 1e-9 for k, v in want.items())


def test_bounded_search_moves_few_postings(spark):
    """The same rows as without bounds, ties and queries of few hits included; common words' postings mostly stay."""
    r = random.Random(23)
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}" for k in range(300)]
    text = lambda: " ".join([*r.choices(common, k=r.randint(5, 40)), *r.sample(rare, k=r.choice((0, 0, 0, 1, 2)))])
    rows = [(f"n{n}", k, text()) for n in range(250) for k in range(16)]
    rows += [("same", k, "c1 r1 r2") for k in range(30)] + [("empty", 0, ""), ("once", 0, "seldom c2")]
    postings, stats = lexical.index(spark.createDataFrame(rows, "note_path string, seq int, text string").repartition(4))
    postings = postings.cache()
    asked = [*(f"{rare[n]} {rare[n + 40]} " + " ".join(common[:12]) for n in range(20)), "seldom c2", "missing", "", "c1 r1 c1", "c3"]
    words = lexical.query_words(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    for limit in (1, 7):
        rows = [[tuple(x)[:3] + (round(x["score"], 8), x["rank"]) for x in lexical.best(postings, stats, words, limit, bounded=b).orderBy("query_id", "rank").collect()] for b in (False, True)]
        assert rows[0] == rows[1] and len(rows[0]) > 20 * limit
    some = words.filter("query_id < 5")
    (a,) = lexical.asked(postings, stats, some)
    moved = lexical.reaching(a, lexical._schema(postings, some), 7).count()
    assert 0 < moved < a.own.count() / 5


def coverage(spark, total, dfs):
    terms = [f"t{k}" for k in range(len(dfs))]
    postings = spark.createDataFrame([(x, "n", k, 1) for x, df in zip(terms, dfs, strict=True) for k in range(df)] or [("other", "n", 0, 1)], "term string, note_path string, seq int, tf int")
    stats = spark.createDataFrame([("n", k, 1) for k in range(total)], "note_path string, seq int, dl int")
    words = spark.createDataFrame([(1, k, x) for k, x in enumerate(terms)], "query_id long, pos int, term string")
    return lexical.evidence(postings, stats, words).first()["coverage"]


def test_coverage(spark):
    assert coverage(spark, 15, (3, 7)) == 1.0 and coverage(spark, 100, (100,)) is None and coverage(spark, 100, (95, 0, 0)) < 0.02


def test_verdict(spark):
    v = lambda c, d, bar=0.54: spark.range(1).select(lexical.vouched(F.lit(c).cast("double"), F.lit(d).cast("double"), min_cos=bar)).first()[0]
    assert (v(0.2, None), v(0.1, 0.54), v(0.1, 0.5), v(None, None), v(1.0, 1.0, None)) == (True, True, False, False, None)


def vectors(spark, n=60, chunks=3, dim=5):
    r = random.Random(1)
    return [(f"n{k}", s, [r.gauss(0, 1) for _ in range(dim)]) for k in range(n) for s in range(chunks)]


def test_two_stages_equal_one(spark):
    rows = vectors(spark)
    df = spark.createDataFrame(rows, "note_path string, seq int, vector array<double>")
    linked = spark.createDataFrame([("n0", "n1"), ("n5", "n0")], "a string, b string")
    got = discover.similar(df, discover.centroids(df), linked, spark.createDataFrame([("n0",)], "anchor string"), 10).orderBy("rank").collect()
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = [v for p, _, v in rows if p == "n0"]
    best = {}
    for p, s, v in rows:
        if p not in ("n0", "n1", "n5"):
            best[p] = min(best.get(p, (9e9, 0)), (min(d2(v, o) for o in own), s))
    want = sorted((d, p, s) for p, (d, s) in best.items())
    assert [(x["path"], x["seq"]) for x in got] == [(p, s) for _, p, s in want[:10]]
    mean = sum(d for d, _, _ in want) / len(want)
    sd = (sum((d - mean) ** 2 for d, _, _ in want) / (len(want) - 1)) ** 0.5
    assert all(abs(x["z"] - (mean - w[0]) / sd) < 1e-9 for x, w in zip(got, want, strict=False))


def test_small_populations_are_not_graded(spark):
    df = spark.createDataFrame(vectors(spark, n=10), "note_path string, seq int, vector array<double>")
    none = spark.createDataFrame([], "a string, b string")
    got = discover.similar(df, discover.centroids(df), none, spark.createDataFrame([("n0",)], "anchor string"), 5).collect()
    assert len(got) == 5 and all(x["z"] is None and x["band"] is None for x in got)


def test_nearest_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame(vectors(spark), "note_path string, seq int, vector array<double>")
    asked = df.filter("seq = 0").select(F.regexp_extract("note_path", "(\\d+)", 1).cast("long").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = sorted(map(tuple, search.nearest(df, asked, 4).collect()))
    real = search.blocks
    monkeypatch.setattr(search, "blocks", lambda q, key: real(q, key, 7))
    assert sorted(map(tuple, search.nearest(df, asked, 4).collect())) == whole and len(whole) == 240


def test_hops_and_neighbours(spark):
    e = spark.createDataFrame([("a", "b", None, "references"), ("b", "c", None, "supports"), ("d", "a", None, "supports"), ("a", None, "f.png", "references"), ("a", None, None, "references")], "src_path string, dst_path string, dst_resource_path string, type string").selectExpr("*", "coalesce(dst_path, dst_resource_path, 'gone') AS dst_path_raw", "'inline' AS origin", "null AS explanation", "0 AS occurrence_index")
    hops = {(r["path"], r["hop"]) for r in graph.reachable(e, spark.createDataFrame([("a",)], "anchor string"), 2).collect()}
    assert hops == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    notes = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", None)], "path string, created string")
    got = [(r["path"], r["direction"], r["label"]) for r in graph.neighbors(e, notes, spark.createDataFrame([("a",)], "anchor string")).orderBy("at").collect()]
    assert got == [("b", "out", "references"), ("d", "in", "supported-by")]
    assert [r["target"] for r in graph.dangling(e).collect()] == ["gone"] and [r["path"] for r in graph.orphans(notes, e).collect()] == ["d"]


LINKS = [
    ("[[a|x]] ![[b.png]] [t](c.md) ![i]( d.png )", [("a", "x", False, False), ("b.png", None, True, False), ("c.md", "t", False, True), ("d.png", "i", True, True)]),
    ("[[open [[a]]", [("open [[a", None, False, False)]),
    ("[[no](x.md) [w](http://e) [f](#z) [e]()\n[[]] [[ | y]]", [("x.md", "no", False, True)]),
    ("```\n[[in fence]]\n```", [("in fence", None, False, False)]),
    ("[a]\n(b) [x [y](z)", [("z", "x [y", False, True)]),
]


@pytest.mark.parametrize(("body", "want"), LINKS)
def test_body_links(spark, body, want):
    rows = graph.body_links(spark.createDataFrame([("n", body)], "path string, body string")).orderBy("pos").collect()
    assert [(r["target"], r["caption"], r["embed"], r["md"]) for r in rows] == want


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 9)], "query_id long, rank int")
    got = metrics.quality(ranks).first()
    assert (got["queries"], got["hit1"], got["hit3"], got["mrr"]) == (4, 0.25, 0.25, 0.3125)
    values = spark.createDataFrame([(0.1, False), (0.4, True)], "v double, k boolean")
    assert metrics.window(values, "v", "k").first()["admissible"]


def test_stemmed_search_against_brute_force(spark, sf):
    """All lines and all queries of the registered query, scored in plain Python."""
    import math
    from collections import Counter

    from quillspark.functions import text as words
    from quillspark.plans import queries_search
    from quillspark.plans import tables as x

    stem = {}
    split = lambda rows, c: [(r[0], [stem.setdefault(w, words.porter(w)) for w in r[1]]) for r in rows.select("id", words.tokens(rows[c]).alias("t")).collect()]
    lines = split(x.chunks(spark, sf).selectExpr("struct(note_path, seq) AS id", "text"), "text")
    asked = split(x.queries(spark, sf).selectExpr("query_id AS id", "query"), "query")
    df, mean = Counter(w for _, ws in lines for w in set(ws)), sum(len(ws) for _, ws in lines) / len(lines)
    counts = [(k, Counter(ws), len(ws)) for k, ws in lines]
    want = {}
    for q, ws in asked:
        weight = {w: n * max(math.log((len(lines) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) for w, n in Counter(ws).items() if df[w]}
        scored = [(-round(sum(weight[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in weight.keys() & c.keys()), 9), k["note_path"], k["seq"]) for k, c, n in counts if weight.keys() & c.keys()]
        for rank, (score, path, seq) in enumerate(sorted(scored)[:10]):
            want[q, rank] = path, seq, round(-score, 6)
    got = {(r["query_id"], r["rank"]): (r["note_path"], r["seq"], round(r["score"], 6)) for r in queries_search.keyword_search_stemmed(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 2e-6 for k in got)
