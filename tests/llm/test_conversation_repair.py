from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import conversation_repair as c
from quillspark.llm import oracle, queries

GOOD = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Every sequence of edits with up to two inserted turns at each place, by cost and then by its letters."""
    best = None
    options = [[("D", 4, "")] if x == "D" else [("D", 4, ""), ("K", 3 * x.isupper(), x.lower()), ("R", 3 + 3 * x.isupper(), "u"), ("R", 3 + 3 * x.isupper(), "a")] for x in rows]
    put = [("", 0, ""), *[("I" * n, 3 * n, "".join(r)) for n in (1, 2) for r in itertools.product("ua", repeat=n)]]
    for edits in itertools.product(*options):
        base = sum(e[1] for e in edits)
        if best and base > best[0]:
            continue
        for gaps in itertools.product(put, repeat=len(rows) + 1):
            cost = base + sum(g[1] for g in gaps)
            if best and cost > best[0]:
                continue
            if GOOD.fullmatch("".join(g[2] + e[2] for g, e in itertools.zip_longest(gaps, edits, fillvalue=("", 0, "")))):
                audit = "".join(g[0] + e[0] for g, e in itertools.zip_longest(gaps, edits, fillvalue=("", 0, "")))
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_against_all_edits(n):
    for rows in itertools.product("suaxSUAD" if n < 3 else "suaUD", repeat=n):
        assert c.search("".join(rows)) == brute(rows), rows


@given(st.text("suaxSUAXD", min_size=1, max_size=30), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_blocks_join_to_the_whole(rows, size):
    """Tables of blocks, joined, give what one search gives."""
    import pyarrow as pa

    cut = [rows[k : k + size] for k in range(0, len(rows), size)]
    made = [b.to_pylist()[0] for b in c._tables(iter([pa.RecordBatch.from_pylist([{"key": "+1", "block": k, "first": k, "rows": x} for k, x in enumerate(cut)])]))]
    one = next(c._joined(iter([pa.RecordBatch.from_pylist([{"key": "+1", "blocks": made}])]))).to_pylist()[0]
    audit = "".join(made[p["block"]]["audits"][p["pick"]] for p in one["picks"]) + one["tail"]
    assert (one["cost"] + 0, audit) == c.search(rows)


def test_the_bound_ahead_is_never_over_the_cost():
    draw = random.Random(3)
    for _ in range(300):
        rows = "".join(draw.choices("suaxSUAXD", k=draw.randint(0, 12)))
        for start in range(4):
            found = [x[0] for end in range(4) if (x := c.search(rows, start, end))]
            assert all(cost >= sum(map(c._least, rows)) for cost in found)


def expected(rows):
    """The report of a conversation's (turn, role, text) in order, row by row."""
    seen, told = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        told.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    code = "".join("D" if t in ("blank", "duplicate") else (lambda x: x.upper() if t else x)(r[1][:1] if r[1][:1] in set("sua") else "x") for r, t in zip(rows, told, strict=True))
    cost, audit = c.search(code)
    turns, state, at = [], "", 0
    for e in audit:
        role, text = ("", "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e == "D":
            continue
        role = role if e == "K" else "assistant" if state == "u" else "user"
        state = role[:1]
        turns.append(f"{role}:{text}")
    own = [t for t, _, _ in rows if t is not None]
    gaps = max(own) - min(own) + 1 - len(set(own)) if own else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def told(spark, rows, monkeypatch=None, **bounds):
    """The reports of rows (conv_id, turn, role, text) by conversation, through the query's own digest."""
    frame = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "conv_id long, turn long, role string, text string, copies int, key string, at long").repartition(3)
    reports, turns = c.repair(frame, **bounds)
    out = {}
    hashes = {} if turns is None else {r["conv_id"]: r["sha256"] for r in c.hashed(turns).collect()}
    for r in reports.collect():
        own = "\n".join(f"{t['role']}:{t['text']}" for t in r["turns"] or [])
        out[r["conv_id"]] = (*tuple(r)[1:8], hashes.get(r["conv_id"]) or hashlib.sha256(own.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 2, "user", "cut off"), (1, 7, "assistant", "End!"),
    (2, 0, "system", "Be good."), (2, 1, "assistant", "What."), (2, 2, "assistant", "What."), (2, None, "user", "First."),
    (3, 5, "tool", "x"), (4, 0, "user", ""), (4, 1, "user", " \t\n"), (4, 2, "user", ""),
    (5, None, None, None), (5, None, "user", "a."), (None, 3, "user", "No id."), (None, 4, "assistant", "None!  \n"), (None, 4, "assistant", "None!  \n"),
    (6, -(1 << 63), "u", "."), (6, (1 << 63) - 1, "a", "?"), (7, 1, "user", "ends in other blanks. "), (8, 1, "", "empty role."), (9, 1, "user", "long " * 100_000 + "."),
]


def by_conversation(rows):
    filled = [(i, t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows]
    return {i: sorted(((t, r, x) for j, t, r, x in filled if j == i), key=lambda r: (r[0] is not None, r[0] or 0)) for i in {r[0] for r in rows}}


@pytest.mark.parametrize("bounds", [{}, {"most_rows": 0}, {"most_bytes": 30}])
def test_odd_rows_by_both_ways(spark, bounds):
    got = told(spark, ROWS, **bounds)
    # rows of one turn go by a hash, so both orders of those are tried
    for name, rows in by_conversation(ROWS).items():
        want = {expected(list(p)) for p in itertools.permutations(rows) if [(r[0] is not None, r[0] or 0) for r in p] == [(r[0] is not None, r[0] or 0) for r in rows]}
        want = {(min(w[0], (1 << 63) - 1), *w[1:]) for w in want}
        assert got.pop(name) in want
    assert got == {}


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BITS", 4)
    draw = random.Random(9)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool"], ["Fine.", "cut", "", "So?", "a b c."]
    rows = [(1, n if n % 5 else None, draw.choice(roles), f"{n % 90} {draw.choice(texts)}" if n % 11 else "") for n in range(1500)]
    rows = [(i, n, r, x) for n, (i, _, r, x) in enumerate(rows)] + [(2, 0, "user", "Short."), (2, 1, "assistant", "Yes.")]
    got = told(spark, rows)
    for name, own in by_conversation(rows).items():
        assert got[name] == expected(own)


def test_empty_table_and_names_without_rows(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert c.repair(frame.limit(0))[0].collect() == []
    reports, turns = c.repair(frame, (frame["turn"] * 0).isNull().cast("int"))
    rows = {r["conv_id"]: tuple(r)[1:] for r in reports.collect()}
    assert turns is None and set(rows) == {r[0] for r in ROWS} and rows[3] == (0, 0, 0, 0, 0, 0, "", [])


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.sql(oracle.op11_conversation_repair).fetchall())
    assert sorted(tuple(r) for r in queries.op11_conversation_repair(spark, sf).collect()) == want
