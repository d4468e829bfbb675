from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import chunking, frontmatter
from quillspark.functions import paths as p
from quillspark.functions import text as t
from quillspark.functions.chunking import Policy, chunk


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_query_terms(spark):
    assert one(spark, t.query_terms(F.lit("can't sleep")), t.query_terms(F.lit("?!")), t.query_terms(F.lit("a_b 3.14 C++ a"))) == [["can", "t", "sleep"], [], ["a", "b", "3", "14", "C", "a"]]


def test_tokens_fold(spark):
    assert one(spark, t.tokens(F.lit("Ünïcode ÉTÉ x’y")))[0] == ["unicode", "ete", "x", "y"]


@pytest.mark.parametrize(("word", "stem"), [("memories", "memori"), ("universe", "univers"), ("university", "univers"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("happy", "happi"), ("sky", "sky"), ("日本語", "日本語"), ("is", "is")])
def test_porter(word, stem):
    assert t.porter(word) == stem


def test_porter_against_fts5():
    """The stemmer of the SQLite that comes with Python, as a judge."""
    import sqlite3

    r = random.Random(2)
    ends = ["", "s", "es", "ed", "ing", "ation", "ational", "izer", "iveness", "ful", "ness", "ly", "ies", "eed", "ement", "able", "ical", "e", "y", "ion", "ll", "ance", "ousli", "bli"]
    words = sorted({"".join(r.choice("bcdflmnprst") + r.choice("aeiouy") for _ in range(r.randint(1, 3))) + r.choice(["", "t", "l", "ss"]) + e for _ in range(400) for e in ends})
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    want = {row: term for term, row in con.execute("SELECT term, doc FROM v")}
    wrong = [(w, t.porter(w), want[k]) for k, w in enumerate(words) if t.porter(w) != want[k]]
    assert len(wrong) <= 0.01 * len(words), wrong[:20]


def test_snippets(spark):
    long = "word " * 60
    head, tail, none = one(spark, t.head_snippet(F.lit(long)), t.snippet(F.lit(long + "needle end"), F.array(F.lit("Needle"), F.lit("x"))), t.snippet(F.lit("short one"), F.array(F.lit("zz"))))
    assert head.endswith("…") and len(head) <= 161 and tail.startswith("…") and tail.endswith("needle end") and none == "short one"


def test_find_and_cite(spark):
    assert one(spark, t.find_all(F.lit("aXax.a"), F.lit("a")), t.find_all(F.lit("a.b.c"), F.lit(".")), t.find_all(F.lit("abc"), F.lit("")), t.citations(F.lit("[2] [1][9] [2] [x] [0]"), F.lit(3))) == [[0, 2, 5], [1, 3], [], [1, 2]]


def test_paths(spark):
    got = one(spark, t.title(F.lit("a/b.c.MD")), t.title(F.lit(".md")), p.resource_class(F.lit("x.PNG")), p.resource_class(F.lit("x")), p.kind(F.lit("2026.07.14-log")), p.kind(F.lit("a/b")), p.hidden(F.lit("a/.b/c")), p.hidden(F.lit("_a/b.c")), p.external(F.lit("mailto:x")), p.external(F.lit("a/b:c")), p.resolved(F.lit("a/b.md"), F.lit("../c")), p.resolved(F.lit("b.md"), F.lit("../c")))
    assert got == ["b.c", ".md", "image", "binary", "resource", "note", True, False, True, False, "c", None]


def test_labels(spark):
    got = one(spark, *[p.label(F.lit(k), F.lit(d)) for k, d in (("references", "in"), ("supports", "in"), ("contradicts", "in"), ("own-verb", "in"), ("supports", "out"))])
    assert got == ["referenced-by", "supported-by", "contradicts", "own-verb", "supports"]


TINY = Policy(target_tokens=10, chars_per_token=1.0, backscan_tokens=8, overlap=0.2)


@given(st.text(st.sampled_from("ab \n#-|`é1.\t"), max_size=300))
@settings(max_examples=300, deadline=None)
def test_chunks_are_slices_in_order(body):
    raw, last = body.encode(), -1
    for k, (seq, a, b, n, _, text) in enumerate(chunk(body, TINY)):
        assert seq == k and raw[a:b].decode() == text and text == text.strip() and n == len(text) and a >= last
        last = a
    covered = {i for _, a, b, *_ in chunk(body, TINY) for i in range(a, b)}
    assert all(i in covered or raw[i : i + 1].isspace() for i in range(len(raw)))


def test_blocks_are_not_cut():
    fence = "```\n" + "code line\n" * 12 + "```\n"
    table = "| a | b |\n| --- | :-: |\n" + "| 1 | 2 |\n" * 9
    body = "# Top\n\n" + "word " * 20 + "\n\n" + fence + "\nmore " * 9 + "\n\n" + table + "\n## Sub\nend of it all here\n"
    got = chunk(body, TINY)
    assert any(fence.strip() in c[5] for c in got) and any(table.strip() in c[5] for c in got)
    assert got[0][4] == "Top" and got[-1][4] == "Top > Sub"
    assert all(c[5].count("```") % 2 == 0 for c in got)


def test_overlap_and_single_chunk():
    body = "\n\n".join(f"Paragraph {k} with some words in it." for k in range(200))
    got = chunk(body)
    assert len(got) > 3 and all(x[1] < y[1] < x[2] for x, y in zip(got, got[1:], strict=False))
    assert [c[5] for c in chunk("one\n")] == ["one"] and chunk(" \n\t") == [] and chunk(None) == []
    assert chunk("# H\nx", Policy(prepend_heading=True))[0][5] == "H\n\n# H\nx"


def test_heading_in_fence_is_none():
    got = chunk("# A\n```\n# not\n```\n" + "w " * 40, TINY)
    assert {c[4] for c in got} == {"A"}


def test_frontmatter(spark):
    text = '---\ntype: idea\ntitle: 5\ncreated: 2026-06-20\ntags: [a, "b c"]\naliases:\n  - x\n  - \'y\'\nlinks:\n  - "supports [[n/1]] — why: yes"\nother: {a: 1\n---\nBody\n---\n'
    bad, none, crlf = "---\nnot a mapping\n---\nb", "plain --- text", "---\r\ntitle: q\r\n---\r\nz"
    files = spark.createDataFrame([("a.md", text.replace("other: {a: 1\n", "").encode(), 1), ("b.md", bad.encode(), 1), ("c.md", none.encode(), 1), ("d.md", b"\xff\xfe", 1), ("e.md", crlf.encode(), 1), ("f.md", text.encode(), 1)], "path string, content binary, mtime long")
    got = {r["path"]: r for r in frontmatter.notes(files, "links").collect()}
    a = got["a.md"]
    assert (a["type"], a["title"], a["created"], a["tags"], a["aliases"], a["relations"], a["body"], a["readable"]) == ("idea", None, "2026-06-20", ["a", "b c"], ["x", "y"], ["supports [[n/1]] — why: yes"], "Body\n---\n", True)
    assert (got["b.md"]["readable"], got["b.md"]["body"]) == (False, "b") and got["c.md"]["body"] == none
    assert got["d.md"]["reason"] == "is not valid UTF-8" and (got["e.md"]["title"], got["e.md"]["body"]) == ("q", "z") and got["f.md"]["readable"] is False


def test_chunk_table(spark):
    notes = spark.createDataFrame([("a.md", "x\n\ny"), ("b.md", None)], "path string, body string")
    assert [(r["note_path"], r["seq"], r["text"]) for r in chunking.chunks(notes).collect()] == [("a.md", 0, "x\n\ny")]
