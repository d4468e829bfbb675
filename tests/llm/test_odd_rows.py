"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import public_tokenizers
import pytest

from quillspark.llm import decontamination, fingerprints, licenses, line_dedup, mixing, quality, simhash_dedup, token_files, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
ROWS = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (1, "another text", "s"), (2, None, None), (3, "", ""), (None, "no id", "s"), (None, None, None), (4, LONG, "t"), (5, "\u0000\t\n 🙂 ퟿", "é"), (6, " " * 50, "s")]
EXTRA = "part int, key long, row long, gone_id long, best int, kept_id long, taken_copies int, score double, fp long, size int, keys int, n int, h long, places string, component_id long, target double, ghost int, at int"


@pytest.fixture(scope="module")
def docs(spark):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    rows = [(*r, *[None] * len(names)) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {EXTRA}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mix": lambda d, _: mixing.mix(d),
    "near_duplicates": lambda d, _: simhash_dedup.near_duplicates(d),
    "document_fingerprints": lambda d, _: fingerprints.document_fingerprints(d),
    "licenses": lambda d, _: licenses.scan(d),
    "quality": lambda d, x: quality.quality(d, x),
    "toxicity": lambda d, x: toxicity.toxicity(d, x),
    "token_files": lambda d, _: token_files.token_files(d, PATH),
    "line_dedup": lambda d, _: line_dedup.line_dedup(d),
    "decontaminate": lambda d, _: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "b"), (None, None)], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(name, docs, labels):
    found = OPERATORS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels).collect() == []


def test_equal_texts_equal_fingerprints(docs):
    rows = fingerprints.document_fingerprints(docs).collect()
    assert {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"0" * 16}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 2


def test_keep_one_of_repeated_rows(docs):
    kept = simhash_dedup.keep_one(docs)
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    assert got.count("1") == 1 and got.count("None") == 2 and kept.columns == docs.columns
