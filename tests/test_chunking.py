"""The chunker against a plain one that looks at every place with loops."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import chunking
from quillspark.plans import queries_tables

# Unicode's white space
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lines_of(body):
    """(start, end, line) in bytes."""
    at, out = 0, []
    for line in body.split("\n"):
        whole = line + "\n"
        out.append((at, at + len(whole.encode()), line.rstrip("\r")))
        at += len(whole.encode())
    out[-1] = (out[-1][0], len(body.encode()), out[-1][2])
    return [x for x in out if x[0] < x[1]]


def marks(body, policy):
    """{place: worth}, {line's place: heading path}, blocks in which nothing ends."""
    worth, path, blocks, trail, open_at, run = {}, {}, [], [], None, []

    def close_run():
        for i in range(1, len(run)):
            bare = run[i][2].strip(SPACE)
            if "-" in bare and all(c in "-:| " for c in bare):
                blocks.append((run[i - 1][0], run[-1][1]))
                break
        run.clear()

    for start, end, line in lines_of(body):
        bare = line.lstrip(SPACE)
        level = re.match(r"(#{1,6})( |$)", bare)
        if bare[:3] in ("```", "~~~"):
            close_run()
            worth[start] = policy.fence
            if open_at is None:
                open_at = start
            else:
                blocks.append((open_at, end))
                open_at = None
        else:
            inside = open_at is not None
            if not bare:
                worth[start] = policy.blank
            elif level and not inside:
                n = len(level[1])
                worth[start] = policy.headings[n - 1]
                trail = [t for t in trail if t[0] < n] + [(n, bare[n:].strip(SPACE).rstrip("#").strip(SPACE))]
            elif re.match(r"([-*+]|[0-9]+[.)]) ", bare) and not inside:
                worth[start] = policy.item
            else:
                worth[start] = policy.paragraph
            if not inside:
                if "|" in bare:
                    run.append((start, end, line))
                else:
                    close_run()
        path[start] = " > ".join(t for _, t in trail) or None
        for i in range(1, len(line)):
            if line[i - 1] in SPACE and line[i] not in SPACE:
                worth[start + len(line[:i].encode())] = policy.word
    close_run()
    return worth, path, blocks


def naive(body, policy):
    if not body or not body.strip(SPACE):
        return []
    data = body.encode()
    worth, path, blocks = marks(body, policy)
    clear = lambda p: min([b for a, b in blocks if a < p < b], default=p)
    half_up = lambda x: int(x + 0.5)
    target, scan, overlap = max(1, half_up(policy.target_tokens * policy.chars_per_token)), half_up(policy.backscan_tokens * policy.chars_per_token), half_up(policy.target_tokens * policy.overlap * policy.chars_per_token)
    spans, start = [], 0
    while True:
        if len(data) - start <= target:
            spans.append((start, len(data)))
            break
        anchor = min([p for p in worth if p >= start + target], default=len(data))
        value = {p: w * max(0, 1 - (anchor - p) / policy.chars_per_token / policy.backscan_tokens) ** 2 for p, w in worth.items() if max(anchor - scan, start + 1) <= p <= anchor}
        end = clear(max(value, key=lambda p: (value[p], p)) if value else anchor)
        spans.append((start, end))
        if end >= len(data):
            break
        back = [p for p in worth if start < p < end]
        goal = max(0, end - overlap)
        start = clear(min(back, key=lambda p: (abs(p - goal), -worth[p], p)) if overlap and back else end)
    out = []
    for a, b in spans:
        raw = data[a:b].decode()
        text = raw.strip(SPACE)
        if text:
            a += len(raw[: len(raw) - len(raw.lstrip(SPACE))].encode())
            above = path[max(p for p in path if p <= a)]
            shown = f"{above}\n\n{text}" if policy.prepend_heading and above else text
            out.append((len(out), a, a + len(text.encode()), half_up(len(text) / policy.chars_per_token), above, shown))
    return out


LINE = st.sampled_from(["", "# One", "## Two ##", "###### Six", "#no", "word", "some more words here", "- item one", "12) item", "```", "~~~ x", "| a | b |", "|---|:-:|", "x | y", " \t", "été 日本語 wörds ", "a very long line of words " * 4, "end\r"])


@given(st.lists(LINE, max_size=40), st.sampled_from([(5, 0.2, 4), (12, 0.5, 10), (30, 0.0, 20), (8, 0.9, 3)]), st.booleans(), st.booleans())
@settings(max_examples=400, deadline=None)
def test_against_loops(lines, sizes, prepend, ends):
    policy = chunking.Policy(target_tokens=sizes[0], overlap=sizes[1], backscan_tokens=sizes[2], prepend_heading=prepend)
    body = "\n".join(lines) + ("\n" if ends else "")
    assert chunking.chunk(body, policy) == naive(body, policy)


def test_query_against_loops(spark, sf):
    got = {}
    for r in queries_tables.note_chunks(spark, sf).collect():
        got.setdefault(r["note_path"], []).append((r["seq"], r["char_start"], r["char_end"], r["token_count"]))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r in docs:
        assert sorted(got.get(f"{r['source']}/{r['doc_id']}.md", [])) == [c[:4] for c in naive(r["text"], chunking.Policy())]
