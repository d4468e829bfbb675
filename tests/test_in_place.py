"""Keyword search over an index whose chunks hold their own postings: nothing but each task's best rows is shuffled."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import kernels, text
from quillspark.operators import calibrate, lexical


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(5)
    common, rare = ["alpha", "running", "notes", "relational", "Éclair", "runs"], [f"r{k}" for k in range(200)]
    line = lambda: " ".join([*r.choices(common, k=r.randint(1, 12)), *r.sample(rare, k=r.choice((0, 0, 1, 2)))])
    rows = [(f"n{n}", k, line()) for n in range(120) for k in range(20)]
    rows += [("same", k, "alpha r1 r2") for k in range(40)] + [("none", 0, None), ("empty", 0, ""), ("marks", 0, "--")]
    r.shuffle(rows)  # no order of rows is given
    return spark.createDataFrame(rows, "note_path string, seq int, text string").repartition(5).cache()


@pytest.mark.parametrize("stem", [False, True])
def test_same_rows_as_shuffled_postings(spark, chunks, stem):
    rows, (postings, stats) = lexical.gathered(chunks, stem).cache(), lexical.index(chunks, stem)
    assert sorted(map(tuple, lexical.opened(rows).collect())) == sorted(map(tuple, postings.collect()))
    assert sorted(map(str, rows.select("note_path", "seq", "dl").collect())) == sorted(map(str, stats.collect()))
    asked = ["alpha r1 r2 r3", "running notes r17 notes", "eclair", "missing", "", "r1", "relation run r5 r6"]
    words = lexical.query_words(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), stem)
    found = lambda *a, **k: [(*tuple(x)[:3], round(x["score"], 8), x["rank"]) for x in lexical.best(*a, **k).orderBy("query_id", "rank").collect()]
    for limit in (1, 9, 60):
        want = found(postings, stats, words, limit)
        assert want == found(rows, stats, words, limit) == found(rows, stats, words, limit, bounded=True)
    assert sorted(map(tuple, lexical.holders(rows, words).collect())) == sorted(map(tuple, lexical.holders(postings, words).collect()))
    want, got = ([(x["query_id"], x["pos"], x["df"], x["coverage"]) for x in lexical.evidence(p, stats, words).orderBy("query_id", "pos").collect()] for p in (postings, rows))
    assert want == got


def test_many_small_slices(spark, chunks, monkeypatch):
    """Bounds and ties hold where a task's rows come in many pieces, out of order."""
    rows = lexical.gathered(chunks)
    b = pa.RecordBatch.from_pandas(rows.toPandas(), schema=pa.schema([("note_path", pa.string()), ("seq", pa.int32()), ("dl", pa.float64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))]))
    words = lexical.query_words(spark.createDataFrame([(1, "alpha r1 r2"), (2, "notes r9 r10 r11")], "query_id long, query string"))
    (a,) = lexical.asked(rows, rows.select("note_path", "seq", "dl"), words)
    out = []
    for pairs, span in ((1 << 21, 0), (64, 0), (64, 8)):
        monkeypatch.setattr(kernels, "PAIRS", pairs)
        kernel = kernels.in_place(a.ids, a.terms, a.query, a.term, a.weight, a.avgdl, 12, 1.2, 0.75, span)
        found = pa.Table.from_batches(kernel(iter([b]))).to_pylist()
        out.append([(x["query_id"], x["note_path"], x["seq"], round(x["score"], 9)) for x in found])
    assert out[0] == out[1] == out[2] and len(out[0]) == 24


def test_no_posting_is_shuffled(spark, chunks):
    rows = lexical.gathered(chunks).cache()
    words = lexical.query_words(spark.createDataFrame([(1, "alpha r1 r2")], "query_id long, query string"))
    for bounded in (False, True):
        found = plan(lexical.best(rows, rows.select("note_path", "seq", "dl"), words, 5, bounded=bounded))
        assert "hashpartitioning(query_id" in found and "hashpartitioning(note_path" not in found
    assert "Exchange" not in plan(lexical.gathered(chunks, True)).split("InMemoryTableScan")[0]  # stems, too


def test_tokens_of_ascii_and_other_texts(spark):
    texts = ["Don't-stop 3x\tA_b", "don’t Éa½ x", "", "--", None, "ÀB c٣d"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    fast, plain = rows.select(text.tokens(F.col("text")), text.query_terms(text.fold(F.col("text")))).toPandas().T.values.tolist()
    assert [None if x is None else list(x) for x in fast] == [None if x is None else list(x) for x in plain]


def test_calibration_reads_rows_as_postings(spark, chunks):
    rows, (postings, stats) = lexical.gathered(chunks), lexical.index(chunks)
    asked = spark.createDataFrame([(1, "alpha r1"), (2, "notes")], "query_id long, query string")
    for found in (lambda p: calibrate.nonsense(asked, p, 7), lambda p: calibrate.function_words(p, stats, ["alpha", "the"])):
        assert sorted(map(tuple, found(rows).collect())) == sorted(map(tuple, found(postings).collect()))


def test_words_as_the_plain_way_has_them(spark):
    """Each Latin character and mark of punctuation within words, between rows, and rows that only the plain way knows."""
    latin = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070)]]
    texts = ["", None, "--", "ab", "cd", "Ünïcode ß x", *(f"a{c}b {c}" for c in latin), "İstanbul", "ΣΑΣ σας", "c٣d", "日本 x", "𝔘 é—𝟘 Ünd", "x x y", "last"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq int, text string").withColumn("note_path", F.lit("n")).coalesce(1)
    assert rows.filter(text.spelled(F.col("text")) == F.col("text")).count() >= len(latin) + 8
    want = {x["seq"]: x["t"] for x in rows.select("seq", text.tokens(F.col("text")).alias("t")).collect()}
    counts = lambda t: (None, None) if t is None else (len(t), {w: t.count(w) for w in t})
    for x in lexical.gathered(rows).collect():
        assert (x["dl"], None if x["terms"] is None else dict(zip(x["terms"], x["tfs"], strict=True))) == counts(want[x["seq"]]), texts[x["seq"]]


def test_texts_in_many_slices(spark, chunks, monkeypatch):
    rows = chunks.toPandas()
    b = pa.RecordBatch.from_pandas(rows, schema=pa.schema([("note_path", pa.string()), ("seq", pa.int32()), ("text", pa.string())]))
    out = []
    for size in (1 << 22, 50):
        monkeypatch.setattr(kernels, "TEXTS", size)
        made = list(kernels.counted(text.letters(), None)(iter([b, b.slice(7, 30)])))
        out.append([(x["dl"], x["terms"] and sorted(zip(x["terms"], x["tfs"]))) for x in pa.Table.from_batches(made).to_pylist()])
    assert out[0] == out[1] and len(out[0]) == len(rows) + 30 and len(made) > 100


def test_packed_rows_answer_as_lists_do(spark, chunks):
    rows, packed = lexical.gathered(chunks).cache(), lexical.gathered(chunks, packed=True).cache()
    assert dict(packed.dtypes)["terms"] == "string" and dict(packed.dtypes)["tfs"] == "binary"
    assert sorted(map(tuple, lexical.opened(rows).collect())) == sorted(map(tuple, lexical.opened(packed).collect()))
    words = lexical.query_words(spark.createDataFrame([(1, "alpha r1 r2 r3"), (2, "missing"), (3, "eclair notes r9")], "query_id long, query string"))
    stats = rows.select("note_path", "seq", "dl")
    assert sorted(map(str, stats.collect())) == sorted(map(str, packed.select("note_path", "seq", "dl").collect()))
    for bounded in (False, True):
        want, got = (sorted((*tuple(x)[:3], round(x["score"], 8), x["rank"]) for x in lexical.best(p, stats, words, 9, bounded=bounded).collect()) for p in (rows, packed))
        assert want == got and len(got) == 18
    assert sorted(map(tuple, lexical.holders(rows, words).collect())) == sorted(map(tuple, lexical.holders(packed, words).collect()))
