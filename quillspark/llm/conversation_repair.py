"""Conversations made well-formed by the cheapest edits, found by A* on the lattice of edits.

A place in the lattice is how many rows are done and what the repaired roles end in. Keeping a row costs
nothing, another role REROLE, leaving it out DELETE, an empty turn put in anywhere INSERT; a truncated row that stays
costs TRUNCATED besides, and blank and repeated rows must go. What the rows ahead cost at least, whichever edits
are chosen, is a suffix sum of deletions that must be and charges that can't be avoided; with it the search pops
places by (cost so far and ahead, letters of the edits), so the first end it meets is the cheapest and of
these the ASCII-least.

A conversation of bounded size is one search in one task. A longer one is cut into blocks of rows; each block is
searched from every ending to every ending, and the blocks' tables are joined by cost, ties by letters.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, tidy

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text of a conversation that one task takes whole, at most, and the power of two of rows in a block of a longer one.
MOST_ROWS, MOST_BYTES, BLOCK_BITS = 512, 1 << 24, 9

# What repaired roles end in: nothing, the system's turn, the user's, the assistant's
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = {"su", "ua", "au"}
_BLANKS = " \t\n\v\f\r"


def _made(state: int) -> int:
    """What an inserted or a changed turn is, after `state`: the only role that may follow and isn't the system's."""
    return ASSISTANT if state == USER else USER


def fault(role: str, text: str, seen: set) -> str:
    """The first fault of a row, or nothing: blank, duplicate (in `seen`, which it enters), truncated."""
    core = text.strip(_BLANKS)
    told, row = "", hashlib.blake2b(f"{role}\0{text}".encode(), digest_size=16).digest()
    if not core:
        told = "blank"
    elif row in seen:
        told = "duplicate"
    elif core[-1] not in ".!?":
        told = "truncated"
    seen.add(row)
    return told


def code(role: str, told: str) -> str:
    """A row as one letter: D must go, else its role's initial (x: any other), upper case if truncated."""
    if told in ("blank", "duplicate"):
        return "D"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if told == "truncated" else letter


def _moves(letter: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state after it) of the edits that take a row."""
    yield "D", DELETE, state
    if letter != "D":
        charge = TRUNCATED if letter.isupper() else 0
        after = _AFTER.get((state, letter.lower()))
        if after is not None:
            yield "K", charge, after
        yield "R", charge + REROLE, _made(state)


def _least(letter: str) -> int:
    return DELETE if letter == "D" else min(TRUNCATED, DELETE) if letter.isupper() else 0


def search(rows: str, start: int = NOTHING, end: int | None = None) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, ASCII-least edits of `rows`, a letter each, from the ending `start`. To the
    ending `end` with a row's edit last, or, without one, to a whole conversation; None where no way leads."""
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + _least(rows[i])
    heap, closed = [(ahead[0], "", 0, start)], set()
    while heap:
        key, edits, i, state = heapq.heappop(heap)
        if i == len(rows) and (state in (NOTHING, ASSISTANT) if end is None else state == end):
            return key, edits
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = key - ahead[i]
        if i < len(rows):
            for letter, price, after in _moves(rows[i], state):
                heapq.heappush(heap, (cost + price + ahead[i + 1], edits + letter, i + 1, after))
        if i < len(rows) or end is None:
            heapq.heappush(heap, (key + INSERT, edits + "I", i, _made(state)))
    return None


@lru_cache(1 << 16)
def whole(rows: str) -> tuple[int, str]:
    """`search` of a conversation; many have the same letters."""
    return search(rows)  # type: ignore[return-value]


def applied(edits: str, rows: list[tuple[str, str]], state: int = NOTHING) -> list[tuple[str, str]]:
    """The repaired (role, text) turns."""
    out, names, own = [], ("", "", "user", "assistant"), iter(rows)
    for letter in edits:
        role, text = ("", "") if letter == "I" else next(own)
        if letter == "D":
            continue
        if letter == "K":
            state = _AFTER[state, role[:1]]
        else:
            state = _made(state)
            role = names[state]
        out.append((role, text))
    return out


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_WHOLE = f"{_REPORT}, turns array<struct<role: string, text: string>>"


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None or high is None else min(high - low + 1 - distinct, (1 << 63) - 1)


def _repaired(name: int | None, rows: list[tuple]) -> tuple:
    """The report of one conversation's (turn, role, text, copies) in order, and its repaired turns."""
    rows = [r[:3] for r in rows for _ in range(r[3])]
    turns = [t for t, _, _ in rows if t is not None]
    seen: set = set()
    told = [fault(role, text, seen) for _, role, text in rows]
    cost, edits = whole("".join(code(r[1], x) for r, x in zip(rows, told, strict=True)))
    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
    gaps = _gaps(min(turns, default=None), max(turns, default=None), len(set(turns)))
    made = [{"role": r, "text": t} for r, t in applied(edits, [r[1:] for r in rows])]
    return name, gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, edits, made


def _short(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, out, size = None, [], [], 0
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != name:
                    out.append(_repaired(name, held))
                    held = []
                    if len(out) >= 1000 or size > 1 << 22:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], kinds)
                        out, size = [], 0
                name = conv
                held.append(row)
                size += len(row[2])
        if held:
            out.append(_repaired(name, held))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], kinds)

    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    names = [c.split()[0] for c in _REPORT.split(", ")] + ["turns"]
    kinds = pa.schema([(n, pa.string() if n == "audit" else pa.list_(turn) if n == "turns" else pa.int64()) for n in names])
    own = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.xxhash64("role", "text"), "role", "text")
    return own.select("conv_id", "turn", "role", "text", "copies").mapInArrow(tidy(run), _WHOLE)


# The way of long conversations

_TABLE = "key string, block long, first long, costs array<int>, places array<int>, audits array<string>"
_PICK = "key string, cost long, tail string, picks array<struct<block: long, pick: long>>"
_SAID = "key string, block long, first long, audit string, said array<string>"
_INTS, _TEXTS = pa.list_(pa.int32()), pa.list_(pa.string())
_KINDS = {"key": pa.string(), "block": pa.int64(), "first": pa.int64(), "costs": _INTS, "places": _INTS, "audits": _TEXTS, "cost": pa.int64(), "tail": pa.string(), "picks": pa.list_(pa.struct([("block", pa.int64()), ("pick", pa.int64())])), "audit": pa.string(), "said": _TEXTS}


def _row(**cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([cells], pa.schema([(n, _KINDS[n]) for n in cells]))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, from every ending to every ending: the cost, the edits, and the place of these among the
    edits from one ending in ASCII order."""
    for batch in batches:
        for r in batch.to_pylist():
            found = [search(r["rows"], a, b) for a in range(4) for b in range(4)]
            places: list[int | None] = []
            for a in range(4):
                own = sorted(x[1] for x in found[4 * a : 4 * a + 4] if x)
                places += [own.index(x[1]) if x else None for x in found[4 * a : 4 * a + 4]]
            yield _row(key=r["key"], block=r["block"], first=r["first"], costs=[x and x[0] for x in found], places=places, audits=[x and x[1] for x in found])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way through all blocks of a conversation: of ways to one ending the cheapest stays, of equal ones that with
    the ASCII-least edits. No way's edits begin another's, as each ends with the same row's edit, so the order
    of two ways stays as it is from where they part."""
    for batch in batches:
        for r in batch.to_pylist():
            best, backs = {NOTHING: (0, 0)}, []  # by ending: cost, place among the endings' ways
            for b in r["blocks"]:
                ways = sorted((best[a][0] + b["costs"][4 * a + z], best[a][1], b["places"][4 * a + z], a, z) for a in best for z in range(4) if b["costs"][4 * a + z] is not None)
                new, back = {}, {}
                for cost, place, inner, a, z in ways:
                    if z not in new:
                        new[z], back[z] = (cost, place, inner), a
                order = sorted(new, key=lambda z: new[z][1:])
                best = {z: (new[z][0], order.index(z)) for z in new}
                backs.append(back)
            tails = {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
            cost, _, z = min((c + INSERT * len(tails[z]), place, z) for z, (c, place) in best.items())
            tail, picks = tails[z], []
            for b, back in zip(reversed(r["blocks"]), reversed(backs), strict=True):
                picks.append({"block": b["block"], "pick": 4 * back[z] + z})
                z = back[z]
            yield _row(key=r["key"], cost=cost, tail=tail, picks=picks[::-1])


def _says(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's chosen edits what becomes of each row: initials of the turns put in before it, then K, D or
    the initial of its new role in upper case."""
    for batch in batches:
        for r in batch.to_pylist():
            state, said, audit, rows = r["pick"] // 4, [], r["audit"], iter(r["rows"])
            for part in re.findall("I*[DKR]", audit):
                own = ""
                for letter in part:
                    row = None if letter == "I" else next(rows)
                    if letter in "IR":
                        state = _made(state)
                        own += "  ua"[state] if letter == "I" else "  UA"[state]
                    else:
                        state = _AFTER[state, row.lower()] if letter == "K" else state
                        own += letter
                said.append(own)
            yield _row(key=r["key"], block=r["block"], first=r["first"], audit=audit, said=said)


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports without turns, repaired turns) of conversations of any length. Rows meet by ranges of (conversation, turn) and
    by blocks; a conversation as a whole meets as one short row a block, and its edits as one string."""
    name = F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("+"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    own = rows.filter("copies > 0").withColumn("key", name).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    own = own.select("key", "conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("mark"), F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("hash"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc("key"), F.asc_nulls_first("turn"), F.asc("mark"), F.asc("tie")]
    own = cut(own.repartitionByRange(*order).sortWithinPartitions("key", F.asc_nulls_first("turn"), "mark", "role", "text", "tie").withColumn("at", F.monotonically_increasing_id()))
    first = own.groupBy("key", "hash").agg(F.min("at").alias("earliest"))
    core = F.rtrim(F.col("text"), F.lit(_BLANKS))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("told").isin("blank", "duplicate"), "D").when(F.col("told") == "truncated", F.upper(letter)).otherwise(letter)
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    slim = own.select("key", "conv_id", "turn", "role", "at", "hash", F.right(core, F.lit(1)).alias("last")).join(first, ["key", "hash"])
    slim = slim.withColumn("told", F.when(F.col("last") == "", "blank").when(F.col("at") > F.col("earliest"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise(""))
    slim = cut(slim.select("key", "conv_id", "turn", "at", block, "told", initial.alias("initial"), letter.alias("letter")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])
    blocks = slim.groupBy("key", "block").agg(F.min("at").alias("first"), F.array_join(in_order("letter"), "").alias("rows"), in_order("initial").alias("initials"))
    blocks = cut(blocks)
    tables = cut(blocks.select("key", "block", "first", "rows").mapInArrow(tidy(_tables), _TABLE))
    asked = tables.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "costs", "places"))).alias("blocks"))
    picked = cut(asked.mapInArrow(tidy(_joined), _PICK))
    picks = picked.select("key", F.explode("picks").alias("p")).select("key", "p.block", "p.pick")
    chosen = tables.join(picks, ["key", "block"]).join(blocks.select("key", "block", "rows"), ["key", "block"])
    said = cut(chosen.select("key", "block", "first", "pick", "rows", F.get("audits", F.col("pick").cast("int")).alias("audit")).mapInArrow(tidy(_says), _SAID))
    # the reports
    pairs = lambda a: F.aggregate(F.sequence(F.lit(1), F.size(a)), F.lit(0), lambda n, k: n + F.when((k < F.size(a)) & ~F.concat(F.get(a, k - 1), F.get(a, k)).isin(*_LEGAL), 1).otherwise(0))
    ends = blocks.select("key", F.struct("block", F.get("initials", F.lit(0)).alias("a"), F.element_at("initials", -1).alias("z"), pairs(F.col("initials")).alias("n")).alias("e"))
    between = lambda e: F.aggregate(F.sequence(F.lit(1), F.size(e)), F.lit(0).cast("long"), lambda n, k: n + F.get(e, k - 1)["n"] + F.when((k < F.size(e)) & ~F.concat(F.get(e, k - 1)["z"], F.get(e, k)["a"]).isin(*_LEGAL), 1).otherwise(0))
    illegal = ends.groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("e")).select("key", between(F.col("e")).alias("illegal"))
    n = lambda x: F.count_if(F.col("told") == x).alias(x)
    counts = slim.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.min("turn").alias("low"), F.max("turn").alias("high"), n("blank"), n("duplicate"), n("truncated"))
    distinct = slim.groupBy("key", "turn").agg(F.lit(1)).groupBy("key").agg(F.count("turn").alias("turns"))
    audits = said.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("edits"))
    gaps = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.least(gaps, F.lit((1 << 63) - 1))).cast("long")
    report = counts.join(distinct, "key").join(illegal, "key").join(audits, "key").join(picked.select("key", "cost", "tail"), "key")
    report = report.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.concat("edits", "tail").alias("audit"), F.lit(None).cast("array<struct<role: string, text: string>>").alias("turns"))
    # the turns
    names = F.create_map(*[F.lit(x) for x in ("u", "user", "a", "assistant", "U", "user", "A", "assistant")])
    texts = own.withColumn("block", block).join(said.select("key", "block", "first", "said"), ["key", "block"])
    texts = texts.select("conv_id", "at", "role", "text", F.posexplode(F.split(F.get("said", (F.col("at") - F.col("first")).cast("int")), "")).alias("k", "does")).filter("does not in ('D', '')")
    turns = texts.select("conv_id", "at", "k", F.when(F.col("does") == "K", F.col("role")).otherwise(names[F.col("does")]).alias("role"), F.when(F.col("does").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))
    last = picked.filter("tail != ''").select(F.when(F.col("key") != "-", F.col("key").substr(F.lit(2), F.length("key"))).cast("long").alias("conv_id"), F.lit((1 << 63) - 1).alias("at"), F.posexplode(F.when(F.col("tail") == "I", F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))).alias("k", "role"), F.lit("").alias("text"))
    return report, turns.unionByName(last)


def repair(conversations: DataFrame, copies: Column | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """Repairs each conversation in `conversations` (conv_id, turn, role, text), whose rows go by turn, nulls first, and those of
    one turn by the XXH64 hash of role and text, then by role and text.

    Returns (reports, turns). A report is conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and turns, the repaired
    array of (role, text); turns is null for conversations of more than `most_rows` rows or `most_bytes` bytes, whose
    turns are rows (conv_id, at, k, role, text) in order of (at, k) in the second frame, which is None where there are no such.
    `copies` says how often a row stands there, 0 leaving nothing but its conversation's name. Null roles and texts are
    one blank. Null ids are one conversation. A conversation without rows has zeros, an empty audit and no turns; an empty table has no reports.
    Columns beyond the four don't count.
    """
    copies = F.lit(1) if copies is None else copies
    text = F.when(copies > 0, F.coalesce(F.col("text"), F.lit(" "))).otherwise("")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), copies.cast("int").alias("copies"))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text").cast("long")).alias("bytes"))
    many = cut(sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("name")))
    if many.isEmpty():
        return _short(rows), None
    same = F.col("conv_id").eqNullSafe(F.col("name"))
    report, turns = _long(rows.join(many, same, "left_semi"))
    return _short(rows.join(many, same, "left_anti")).unionByName(report), turns


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of `role:text` lines of turns (conv_id, at, k, role, text). A text goes by once, so nothing but
    the state of the hash is held; a conversation's hash, which can't be cut, is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        done = lambda: pa.RecordBatch.from_pylist([{"conv_id": name, "sha256": state.hexdigest()}], pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())]))
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and conv != name:
                    yield done()
                    state = None
                if state is None:
                    name, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield done()

    own = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "role", "text")
    return own.mapInArrow(tidy(run), "conv_id long, sha256 string")
