"""Frontmatter of any depth, against a hand-written set."""

from __future__ import annotations

import json

import pytest

from quillspark.functions import frontmatter, nested

GOOD = [
    ("", {}),
    ("a: 1\nb: two words # said\nc: 'it''s'\nd: \"x \\\"y\\\" \\\\ \\n\"\ne:\nf: ~\ng: true\nh: -2.5\n", {"a": 1, "b": "two words", "c": "it's", "d": 'x "y" \\ \n', "e": None, "f": None, "g": True, "h": -2.5}),
    ("a:\n  b:\n    c: 1\n    d: [x, 'y, z', {k: v, n: [1, 2]}]\n  e: end\nf: g\n", {"a": {"b": {"c": 1, "d": ["x", "y, z", {"k": "v", "n": [1, 2]}]}, "e": "end"}, "f": "g"}),
    ("l:\n- a\n- b: 1\n  c: 2\n- - x\n  - y\n-\n  z: 3\nm: 1\n", {"l": ["a", {"b": 1, "c": 2}, ["x", "y"], {"z": 3}], "m": 1}),
    ("l:\n  - deep:\n      er: yes it is\n    and: more\n  # a comment\n\n  - last\n", {"l": [{"deep": {"er": "yes it is"}, "and": "more"}, "last"]}),
    ("t: |\n  one\n    two\n\n  three\nu: >\n  folded\n  here\n\n  again\nv: |-\n  no end\nw: |+\n  kept\n\nx: 1\n", {"t": "one\n  two\n\nthree\n", "u": "folded here\nagain\n", "v": "no end", "w": "kept\n\n", "x": 1}),
    ("long: it goes\n  on here\n  and here\nnext: 1\n", {"long": "it goes on here and here", "next": 1}),
    ("\"quoted key\": 1\nkey with words: 2\nurl: http://x.y/z#frag\nrel:\n  - \"supports [[a|b]] — why\"\n  - cites [[c]]: why\n", {"quoted key": 1, "key with words": 2, "url": "http://x.y/z#frag", "rel": ["supports [[a|b]] — why", "cites [[c]]: why"]}),
    ("n: nan\ni: inf\nu: 1_000\nempty: []\nnone: {}\nday: 2026-01-02\n", {"n": "nan", "i": "inf", "u": "1_000", "empty": [], "none": {}, "day": "2026-01-02"}),
    ("a: |\n  # no comment\n  - no item\nb: 1\n", {"a": "# no comment\n- no item\n", "b": 1}),
]
BAD = ["a: 1\na: 2\n", "a: [1, 2\n", "just text\n", "a: {b 1}\n", "\ta: 1\n", "a: &x 1\n", "a: *x\n", "a: 'open\n", "a:\n    b: 1\n  c: 2\n", "- a\n", "a: \"x\" y\n", "a: {k: 1, k: 2}\n", "a: !tag x\n"]


@pytest.mark.parametrize(("text", "want"), GOOD)
def test_values(text, want):
    assert nested.tree(text.splitlines()) == want


@pytest.mark.parametrize("text", BAD)
def test_unreadable(text):
    with pytest.raises(nested.Unreadable):
        nested.tree(text.splitlines())
    assert frontmatter.fields(f"---\n{text}---\n") == ({}, False)


def test_notes_have_all_of_it(spark):
    files = [(f"{n}.md", f"---\n{text}---\nBody {n}\n".encode(), n) for n, (text, _) in enumerate(GOOD)] + [(f"bad{n}.md", f"---\n{text}---\nBody\n".encode(), 0) for n, text in enumerate(BAD)]
    rows = {r["path"]: r for r in frontmatter.notes(spark.createDataFrame(files, "path string, content binary, mtime long")).collect()}
    for n, (_, want) in enumerate(GOOD):
        got = rows[f"{n}.md"]
        assert got["readable"] and json.loads(got["properties"].toJson()) == want and got["body"] == f"Body {n}\n"
    assert all(not rows[f"bad{n}.md"]["readable"] and rows[f"bad{n}.md"]["properties"].toJson() == "{}" for n in range(len(BAD)))
    typed = [("x.md", b"---\ntype: {a: 1}\ntitle: [x]\naliases: one\ntags: [a, 1, b]\ncreated: 2026\n---\n", 0)]
    one = frontmatter.notes(spark.createDataFrame(typed, "path string, content binary, mtime long")).first()
    assert (one["type"], one["title"], one["aliases"], one["tags"], one["created"]) == (None, None, ["one"], ["a", "b"], "2026")
