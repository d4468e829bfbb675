from __future__ import annotations

import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, decoders, models, pre_tokenizers

from quillspark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Speculator(PATH)
V = OWN.vocabulary


def check(own, library, texts):
    ids, lengths = own.encode(texts)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert own.decode(ids.astype(np.int64), lengths) == [library.decode(w, skip_special_tokens=False) for w in want]


ODD = ["", None, "\1", "\0", "\1a", "a  b", "x\ty", "  lead", "trail ", "a\n\nb", "don't 's it'S", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y\n", "日本語 テスト。 🙂 🙂", "x" * 300 + " y", "　  \x85", "é́́ß ﬁ ſ", "12 ３４ ²½", "=" * 200 + "-" * 67]


@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=20), st.text(st.sampled_from("abehnrst'. ,\n\t1é\0\1🙂"), max_size=30)), max_size=10))
@settings(max_examples=300, deadline=None)
def test_is_the_library(texts):
    check(OWN, LIBRARY, texts)


def test_random_words_of_tokens():
    draw = random.Random(5)
    tokens = [t for i in draw.sample(range(50_000), 400) if (t := V.bytes[i].decode("utf-8", "ignore"))]
    check(OWN, LIBRARY, [" ".join("".join(draw.choices(tokens, k=draw.randint(1, 5))) for _ in range(40)) for _ in range(300)])


def test_all_documents(sf, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(OWN, LIBRARY, texts)


def naive(piece):
    """Merging by the book: of all pairs the earliest rank, of equal ones the leftmost, until none is left."""
    ids = [V.byte_id[b] for b in piece]
    while hits := [(V.merges[p][0], k) for k, p in enumerate(itertools.pairwise(ids)) if p in V.merges]:
        _, k = min(hits)
        ids[k : k + 2] = [V.merges[ids[k], ids[k + 1]][1]]
    return ids


def test_merging_by_the_book():
    draw = random.Random(7)
    pieces = [bytes(draw.choices(b"aehinorst ABC.-=\xc3\xa9\xe6\x97\xa5", k=draw.randint(1, 40))) for _ in range(600)] + [b"a" * n for n in range(1, 45)]
    ids, n = V.merged_together(pieces)
    ends = np.cumsum(n)
    for k, piece in enumerate(pieces):
        want = naive(piece)
        assert V.merged(piece) == want and ids[ends[k] - n[k] : ends[k]].tolist() == want


def test_pairs_hold_where_merging_gives_them():
    draw = random.Random(11)
    pairs = [(draw.randrange(50_000), draw.randrange(50_000)) for _ in range(500)]
    pairs += [tuple(ids[k : k + 2]) for w in range(400) if len(ids := V.proposals([bytes(draw.choices(b"aeinorst hd", k=9))])[0].tolist()) > 1 for k in range(len(ids) - 1)]
    good = V.compatible(*np.array(pairs).T)
    assert good.any() and not good.all()
    for (a, b), held in zip(pairs, good.tolist(), strict=True):
        assert held == (naive(V.bytes[a] + V.bytes[b]) == [a, b])


def test_only_failing_words_are_merged(monkeypatch):
    words = [b" the", b" than", b" inthan", b" theaer", b"thwhst", b" analysis", b"zzzz"]
    greedy, n = V.proposals(words)
    cut = np.split(greedy, np.cumsum(n)[:-1])
    fail = [w for w, ids in zip(words, cut, strict=True) if ids.tolist() != naive(w)]
    seen = []
    merge = bpe.Vocabulary.merged_together
    monkeypatch.setattr(bpe.Vocabulary, "merged_together", lambda self, pieces: (seen.extend(pieces), merge(self, pieces))[1])
    V.encoded(words)
    assert seen == fail and 0 < len(fail) < len(words)
    monkeypatch.setattr(bpe.Vocabulary, "compatible", lambda self, a, b: np.ones(len(a), bool))
    assert V.encoded(words)[0].tolist() != [i for w in words for i in naive(w)]


@pytest.mark.parametrize("seed", range(6))
def test_other_vocabularies(tmp_path, seed):
    """Merges that aren't a trainer's: of any earlier tokens, the same string by two ways, tokens that are never reached."""
    draw = random.Random(seed)
    letters = {c: n for n, c in enumerate(sorted(bpe._LETTER_BYTES))}
    vocab, merges, pool = dict(letters), [], list("abcdeĠ")
    while len(merges) < 60:
        a, b = draw.choices(pool, k=2)
        if (a, b) not in merges and len(a + b) < 9:
            merges.append((a, b))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                pool.append(a + b)
    library = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    library.pre_tokenizer, library.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    library.save(str(tmp_path / "v.json"))
    texts = ["".join(draw.choices("abcde ", k=draw.randint(0, 60))) for _ in range(400)]
    check(bpe.Speculator(str(tmp_path / "v.json")), library, texts)


def test_a_full_table_starts_anew():
    own = bpe.Speculator(PATH, kept=3)
    for texts in (["one two three four"], ["five <|endoftext|> one  x", "six"], ["five six one two"]):
        check(own, LIBRARY, texts)


def test_other_kinds_are_refused(tmp_path):
    own = json.load(open(PATH))
    own["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(own))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        OWN.decode(np.array([60_000]), np.array([1]))


def test_broken_bytes_decode_as_in_the_library():
    ids = [V.byte_id[b] for b in (0xE6, 0x97, 0x41, 0xFF, 0xC3, 0xA9, 0xF0, 0x9F, 0x99)]
    assert OWN.decode(np.array(ids), np.array([len(ids)])) == [LIBRARY.decode(ids, skip_special_tokens=False)]


def test_query_and_odd_rows(spark, sf):
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[doc_id]) == (doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 1, "y"), (2, "", 1, None), (3, "long " * 300_000, 2, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    back = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert bpe.decode(bpe.encode(odd.limit(0), PATH), PATH).collect() == []
