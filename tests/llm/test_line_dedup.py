from __future__ import annotations

import random

from quillspark.llm import line_dedup as ld


def test_lines_are_the_text():
    for text in ("", "a. b. c", "One two three four five. Six seven eight nine ten. x\ny\n\nz", "no end", "a\r\nb! c? d", " . . . \n", None):
        assert "".join(x for x, _ in ld.cut_lines(text)) == (text or "")
    assert [n for _, n in ld.cut_lines("One two three four five. Six. Seven\neight")] == [5, 2, 1]


def longest(pairs):
    best = 0
    rows = sorted(pairs)
    at = [0] * len(rows)
    for i, (_, b) in enumerate(rows):
        at[i] = 1 + max((at[j] for j in range(i) if rows[j][1] < b), default=0)
        best = max(best, at[i])
    return best


def test_increasing_is_longest():
    r = random.Random(1)
    for _ in range(100):
        n = r.randint(0, 30)
        pairs = list(enumerate(r.sample(range(100), n)))
        got = ld._increasing(pairs)
        assert len(got) == longest(pairs) and all(x < y and a < b for (x, a), (y, b) in zip(got, got[1:], strict=False))


def test_align_takes_rare_lines_first():
    assert ld.align([(0, 5, False), (1, 6, True), (2, 0, False), (3, 7, True), (4, 9, False)]) == [(0, 5), (1, 6), (3, 7), (4, 9)]
    assert ld.align([]) == [] and ld.align([(2, 1, False), (1, 2, False)]) in ([(1, 2)], [(2, 1)])


def test_blocks_need_words_and_neighbours():
    words = dict.fromkeys(range(10), 4)
    assert ld.blocks([(0, 3), (1, 4), (3, 6), (4, 9), (5, 10), (6, 11)], words, 8) == [0, 1, 4, 5, 6]


def sentences(r, n, k=9):
    return [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(k)) + "." for _ in range(n)]


def test_passages_go_from_later_documents(spark):
    """A passage in very many documents, within lines or as lines, stays in the first alone."""
    r = random.Random(6)
    passage, docs, own = sentences(r, 6), [], {}
    for n in range(200):
        mine = sentences(r, 8)
        own[n] = mine
        text = mine[:4] + (passage if n % 2 else []) + mine[4:]
        docs.append((n, ("\n" if n % 4 == 1 else " ").join(text), "keep"))
    docs += [(500, docs[0][1], "copy"), (501, None, "null"), (502, "", "empty"), (None, docs[1][1], "no id"), (1, docs[1][1], "again")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, removed string")
    found = ld.line_dedup(rows)
    assert found.columns == ["doc_id", "text", "removed", "removed_words"]
    got = [(x["doc_id"], x["text"], x["removed"]) for x in found.collect()]
    assert len(got) == len(docs)
    for doc_id, text, removed in got:
        if doc_id is None or doc_id == 1:
            assert all(s in text for s in passage) and not removed
        elif doc_id == 500:
            assert text.strip() == ""
        elif doc_id == 501:
            assert text is None
        elif doc_id == 502:
            assert text == ""
        else:
            assert all(s in text for s in own[doc_id]) and (doc_id == 1 or not any(s in text for s in passage)), doc_id
            assert bool(removed) == (doc_id % 2 == 1)


def test_same_line_many_times(spark):
    line = "the same line of nine words again and again."
    docs = spark.createDataFrame([(1, "\n".join([line] * 3)), (2, "\n".join([line] * 5))], "doc_id long, text string")
    got = {x["doc_id"]: x for x in ld.line_dedup(docs).collect()}
    assert got[1]["removed"] == [] and got[2]["removed"] == [0, 1, 2] and got[2]["text"] == "\n".join([line] * 2)
    assert ld.line_dedup(docs.limit(0)).count() == 0


def test_common_blocks_in_any_order(spark):
    """Passages that two documents have in another order go from the later one, all of them."""
    r = random.Random(8)
    a, b, c, x, y = (sentences(r, n) for n in (3, 3, 4, 2, 2))
    docs = [(1, " ".join([*a, *x, *b, *c])), (2, " ".join([*c, *b, *y, *a]))]
    got = {d["doc_id"]: d for d in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["removed"] == [] and got[2]["removed"] == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11]
    assert got[2]["text"].strip() == " ".join(y)


def test_common_blocks_against_all_runs():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(0, 14)
        later, early = r.sample(range(18), n), r.sample(range(18), n)
        pairs = [(a, b, r.random() < 0.5) for a, b in zip(later, early, strict=True)]
        words, held, want = {k: r.randint(1, 6) for k in range(18)}, {(a, b) for a, b, _ in pairs}, set()
        for a, b in held:
            run = [k for k in range(18) if (a + k, b + k) in held and all((a + i, b + i) in held for i in range(k))]
            if sum(words[a + k] for k in run) >= 8:
                want |= {a + k for k in run}
        assert ld.common_blocks(pairs, words, 8) == sorted(want)


def test_blank_lines_cut_no_block(spark):
    r = random.Random(12)
    passage, mine, other = (sentences(r, n, 6) for n in (10, 2, 2))
    docs = [(1, "\n".join([*passage, *other])), (2, "\n\n".join([mine[0], *passage, mine[1]]) + "\n"), (3, "\n \n\n".join(passage[:2]) + "\n" + mine[0])]
    got = {d["doc_id"]: d for d in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["removed"] == [] and got[2]["removed"] == list(range(2, 21)) and got[2]["removed_words"] == 60
    assert got[2]["text"] == f"{mine[0]}\n\n\n{mine[1]}\n"
    assert got[3]["removed"] == [0, 1, 2, 3] and got[3]["text"] == mine[0]


def probe(spark, *texts):
    rows = ld.line_dedup(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")).collect()
    return {d["doc_id"]: d["removed"] for d in rows}


def test_block_whose_lines_have_other_first_holders(spark):
    x, y, z = "one two three four five six.", "seven eight nine ten eleven twelve.", "a b c d e f."
    assert probe(spark, x, f"{x} {y}", f"{x} {y}") == {1: [], 2: [], 3: [0, 1]}
    assert probe(spark, f"{x} {y}", f"{y} {z}", f"{z} {x} {y} {z}") == {1: [], 2: [], 3: [1, 2, 3]}


def test_short_shared_line_alone(spark):
    assert probe(spark, "one two three four five six. other words stand here now.", "one two three four five six. more words of its own here.") == {1: [], 2: []}


def test_rows_with_one_id_and_several_texts(spark):
    r = random.Random(31)
    a, b = sentences(r, 3), sentences(r, 3)
    docs = [(1, " ".join(a), 0), (2, " ".join([*b, *a]), 1), (2, " ".join([*a, *b]), 2), (2, " ".join(b), 3)]
    got = {d["row"]: d["removed"] for d in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string, row int")).collect()}
    assert got == {0: [], 1: [3, 4, 5], 2: [0, 1, 2], 3: []}


def test_against_brute_force(spark):
    """Exactly the lines in runs of 8 words or more that an earlier document has in a row go, short lines included."""
    r = random.Random(13)
    pool = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 60)) for _ in range(r.randint(1, 7))) for _ in range(40)]
    docs = []
    for n in range(120):
        own = []
        while len(own) < 12:
            k = r.randrange(len(pool) - 5)
            own += pool[k : k + r.randint(1, 5)] if r.random() < 0.7 else [f"own {n} {len(own)}"]
        docs.append((n, "\n".join(dict.fromkeys(own))))  # no line twice in a document
    got = {d["doc_id"]: d for d in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    runs, some = set(), 0
    for n, text in docs:
        own = [x for x, _ in ld.cut_lines(text)]
        keys, words = [x.strip() for x in own], [len(x.split()) for x in own]
        all_runs = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if sum(words[i:j]) >= 8]
        gone = sorted({k for i, j in all_runs if tuple(keys[i:j]) in runs for k in range(i, j)})
        assert got[n]["removed"] == gone, n
        assert got[n]["removed_words"] == sum(words[k] for k in gone)
        some += bool(gone)
        runs |= {tuple(keys[i:j]) for i, j in all_runs}
    assert some > 60


def test_orders_hold_all_pairs():
    """The first order is a longest one where all lines are rare, later ones have what is left, each grows in both documents."""
    r = random.Random(17)
    for _ in range(200):
        pairs = {(r.randint(0, 20), r.randint(0, 20)) for _ in range(r.randint(0, 30))}
        got = list(ld.orders([(a, b, True) for a, b in pairs]))
        assert sorted(p for x in got for p in x) == sorted(pairs)
        for x in got:
            assert all(a < c and b < e for (a, b), (c, e) in zip(x, x[1:], strict=False))
        if pairs:
            rows, best = sorted(pairs), {}
            for a, b in rows:
                best[a, b] = 1 + max((best[c, e] for c, e in rows if c < a and e < b), default=0)
            assert len(got[0]) == max(best.values())


def test_the_alignment_decides(spark, monkeypatch):
    """What isn't aligned stays: with alignments that find nothing, no line goes."""
    r = random.Random(18)
    a, b = sentences(r, 3), sentences(r, 3)
    docs = [" ".join([*a, *b]), " ".join([*b, *a])]
    assert probe(spark, *docs) == {1: [], 2: [0, 1, 2, 3, 4, 5]}
    rows = [(0, 3, True), (1, 4, True), (2, 5, True), (3, 0, True), (4, 1, True), (5, 2, True)]
    words = dict.fromkeys(range(6), 9)
    assert ld.common_blocks(rows, words, 8) == [0, 1, 2, 3, 4, 5]
    monkeypatch.setattr(ld, "align", lambda pairs: [])
    assert ld.common_blocks(rows, words, 8) == []


def test_a_line_between_two_passages_again(spark):
    """Passages that share a line in one document go whole, though an order has the line once."""
    p, q, s = "one two three four five six.", "seven eight nine ten eleven twelve.", "a b c d e f g."
    assert probe(spark, f"{p} {q} {s}", f"{p} {q}\nx\n{q} {s}") == {1: [], 2: [0, 1, 3, 4]}
