"""Grounded questions in bulk: condense, retrieve, prompt, answer by an injected model, resolve citations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as t

PASSAGES = 10


class FakeModel:
    """Answers that follow from the prompt alone: every passage cited once, one marker a token; for tests."""

    #: What it says where there is no passage.
    NOTHING = "The notes have nothing on this."

    def __call__(self, prompt: str, question: str) -> Iterator[str]:
        marks = re.findall(r"(?m)^\[\d+\](?= )", prompt)
        yield "As the notes say:" if marks else self.NOTHING
        yield from (f" {m}" for m in marks)


def event_tokens(lines: Iterable[bytes]) -> Iterator[str]:
    """Tokens of a streamed chat answer (server-sent events, as a model's HTTP client hands on its lines), to be the
    iterator that `answers` asks for. Comments and other fields are passed over, data lines of one event belong together.
    A stream that ends before it says so, an error in it and data that isn't JSON are a ConnectionError."""
    done, data = False, []
    for line in _closed(lines):
        if line.startswith(b"data:"):
            data.append(line[5:].removeprefix(b" "))
        elif not line and data:
            told, data = b"\n".join(data), []
            if told.strip() == b"[DONE]":
                return
            try:
                event = json.loads(told)
            except ValueError:
                raise ConnectionError(f"not JSON: {told[:80]!r}") from None
            if not isinstance(event, dict) or event.get("error"):
                raise ConnectionError(f"the model says: {event!r}")
            for choice in (event.get("choices") or [])[:1]:
                if token := (choice.get("delta") or {}).get("content"):
                    yield token
                done = done or choice.get("finish_reason") is not None
    if not done:
        raise ConnectionError("the answer was cut off")


def _closed(lines: Iterable[bytes]) -> Iterator[bytes]:
    """Lines without their ends, and a blank one that closes the last event."""
    for line in lines:
        yield line.rstrip(b"\r\n")
    yield b""


def questions(turns: DataFrame, rewrite: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """(query_id, question, query) of each conversation in turns (conv_id, turn, role, text): the last
    user turn, and what to search for. A conversation of one turn is its own query; of others,
    `rewrite` makes one of the turns so far, and where it has nothing the question stands."""
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("last"))
    rows = turns.join(asked, "conv_id").filter("turn <= last")
    talk = rows.groupBy("conv_id").agg(F.first("question").alias("question"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("said")))), lambda x: x["said"]), "\n").alias("talk"))
    if rewrite is None:
        return talk.select(F.col("conv_id").alias("query_id"), "question", F.col("question").alias("query"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            many = b["n"] > 1
            new = pd.Series(b["question"].tolist(), index=b.index, dtype=object)
            new[many] = rewrite(b.loc[many, "talk"].tolist())
            new = new.where(new.map(lambda x: isinstance(x, str) and bool(x.strip())), b["question"])
            yield pd.DataFrame({"query_id": b["conv_id"], "question": b["question"], "query": new})

    return talk.mapInPandas(run, "query_id long, question string, query string")


def prompts(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, question, prompt, paths, passages) from passages (query_id, path, heading_path, text, rank)."""
    shown = F.concat(F.lit("["), F.col("rank") + 1, F.lit("] "), F.col("path"), F.when(F.col("heading_path").isNotNull(), F.concat(F.lit(" > "), F.col("heading_path"))).otherwise(""), F.lit("\n"), F.col("text"))
    own = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown"), "path", t.head_snippet(F.col("text")).alias("excerpt")))).alias("p"))
    head = F.lit("Answer from the numbered passages alone and cite them as [n].\n\n")
    return asked.join(own, "query_id", "left").select("query_id", "question", F.concat(head, F.coalesce(F.array_join(F.transform("p", lambda x: x["shown"]), "\n\n"), F.lit(""))).alias("prompt"), F.coalesce(F.transform("p", lambda x: F.struct(x["path"].alias("path"), x["excerpt"].alias("excerpt"))), F.array()).alias("passages"))


def answers(prompted: DataFrame, model: Callable[[str, str], Iterator[str]], stop: Callable[[], bool] | None = None) -> DataFrame:
    """(query_id, answer, cancelled, citations): `model` yields the tokens of an answer to (prompt,
    question); one that breaks off leaves what there was, and so does one after which `stop`, asked
    before every token, says so. Markers beyond the passages stay in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said, broken = [], []
            for prompt, question in zip(b["prompt"], b["question"], strict=True):
                tokens, whole = [], False
                try:
                    for token in model(prompt, question):
                        if stop is not None and stop():
                            break
                        tokens.append(token)
                    else:
                        whole = True
                except (ConnectionError, TimeoutError):
                    pass
                said.append("".join(tokens))
                broken.append(not whole)
            yield pd.DataFrame({"query_id": b["query_id"], "answer": said, "cancelled": broken})

    out = prompted.select("query_id", "question", "prompt").mapInPandas(run, "query_id long, answer string, cancelled boolean").join(prompted.select("query_id", "passages"), "query_id")
    marks = t.citations(F.col("answer"), F.size("passages"))
    cited = F.transform(marks, lambda n: F.struct(n.alias("marker"), F.get("passages", n - 1)["path"].alias("path"), F.get("passages", n - 1)["excerpt"].alias("excerpt")))
    return out.select("query_id", "answer", "cancelled", cited.alias("citations"))


def last_turns(turns: DataFrame, most: int) -> DataFrame:
    """The last `most` turns of each conversation, in order."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= most).drop("_back")
