"""What __spark_entry__.py adds for the corpus operators."""

from __future__ import annotations

from quillspark.llm import oracle
from quillspark.llm import queries as q


def queries() -> dict:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    return {name: sql for name, sql in vars(oracle).items() if name.startswith("op")}
