"""Named queries, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
_PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """A named sub-query that SQL texts may refer to."""
    _PARTS[name] = sql


def compose(sql: str) -> str:
    """Prefix a SQL text with every named sub-query it needs, in order of definition."""
    needed, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in words & _PARTS.keys() - needed:
            needed.add(name)
            todo.append(_PARTS[name])
    if not needed:
        return sql
    body = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in _PARTS.items() if n in needed)
    own = re.match(r"\s*with recursive\s", sql)
    if own:
        return f"WITH RECURSIVE {body},\n{sql[own.end():]}"
    if re.match(r"\s*with\s", sql):
        sql = f"SELECT * FROM ({sql})"
    return f"WITH {body}\n{sql}"


def query(name: str, sql: str | None = None):
    def keep(run):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(run, compose(sql) if sql else None)
        return run
    return keep


def fx(expr: str, digits: int = 6) -> str:
    """SQL twin of exprs.fixed."""
    return f"floor(cast({expr} as double) * 1e{digits} + 0.5) / 1e{digits}"
