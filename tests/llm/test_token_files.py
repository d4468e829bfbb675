from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import token_files as f

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 40), min_size=0, max_size=2500), st.integers(0, 45))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(ids, value):
    x = np.array(ids, np.uint32)
    w = f.WaveletMatrix.build(x, 6)
    assert (w.ids() == x).all() and len(w.ids()) == len(x)
    assert w.count(value) == ids.count(value) and w.occurrences(value) == [i for i, v in enumerate(ids) if v == value]
    low, high = len(ids) // 3, 2 * len(ids) // 3
    assert w.count(value, low, high) == ids[low:high].count(value)
    for i in range(0, len(ids), 97):
        assert w.access(i) == ids[i]
    with pytest.raises(IndexError):
        w.access(len(ids))


TEXTS = ["", "\1", "\0", "a  b", "x\ty", "  lead", "trail ", "a\n\nb", "é b c", "don't 's <|endoftext|> it", "\0 a b", "a b", "12 34\nx", "a.. b,c, d.", "word. word, (word) É. 日本語 テスト。 🙂 🙂", "x" * 300 + " y", "a b c", "a b\nc d.\ne", "Ünï. ünï,"]


@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(st.sampled_from("ab'. ,\n\t1é\0\1"), max_size=12)), max_size=12))
@settings(max_examples=120, deadline=None)
def test_encoder_is_the_library(texts):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    encoder = f._encoder(PATH, 0)
    ids, lengths = encoder.encode(texts)
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_a_full_table_still_encodes():
    library, encoder = Tokenizer.from_file(PATH), f.Encoder(PATH, kept=3)
    for texts in (["one two three four"], ["five six one"], ["five six one two"]):
        ids, _ = encoder.encode(texts)
        assert ids.tolist() == library.encode(texts[0], add_special_tokens=False).ids + [0]


def test_files_round_trip(spark, sf, tmp_path):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"file://{tmp_path}/shards"
    rows = {r["doc_id"]: r for r in f.token_files(docs, PATH, folder=folder).collect()}
    start, whole = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), f.crc32(ids))
        start += len(ids)
        whole += ids
    shards = f.read_shards(spark, folder).orderBy("part", "seq").collect()
    at, value = 0, whole[1]
    for s in shards:
        w = f.WaveletMatrix.stored(s.asDict())
        own = whole[at : at + w.n]
        assert w.count(value) == own.count(value) and w.access(w.n - 1) == own[-1]
        at += w.n
    assert at == len(whole)


def test_small_shards_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(3, None), (1, ""), (2, "a b"), (2, "a b"), (None, "x"), (9, "y " * 5000)], "doc_id long, text string")
    f.write_shards(docs, f"file://{tmp_path}/s", PATH, shard_ids=2)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_tokens"]) for r in f.decoded(f.read_shards(spark, f"file://{tmp_path}/s")).collect())
    library = Tokenizer.from_file(PATH)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
    assert [x[1] for x in rows] == [n("x"), 1, n("a b"), n("a b"), 1, n("y " * 5000)]
    assert f.token_files(docs.limit(0), PATH).collect() == []


@given(st.lists(st.one_of(st.sampled_from(TEXTS), st.text(st.sampled_from("ab'. ,\n1é"), max_size=12)), max_size=6), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_added_tokens_are_the_librarys(texts, at):
    library, encoder = Tokenizer.from_file(PATH), f.Encoder(PATH)
    texts = [*texts, "a <|endoftext|> b", "one two" + "<|endoftext|>" * (at % 3) + ". three", *[t[:at] + "<|endoftext|>" + t[at:] for t in texts]]
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, lengths = encoder.encode(texts)
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_files_hold_added_tokens(spark):
    library = Tokenizer.from_file(PATH)
    texts = ["x y", "a <|endoftext|> b", "<|endoftext|>", "c d <|endoftext", "e"]
    got = {r["doc_id"]: r for r in f.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    start = 0
    for n, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert (got[n]["start"], got[n]["n_tokens"], got[n]["ids_crc32"]) == (start, len(ids), f.crc32(ids))
        start += len(ids)
