"""Register a query together with the SQL that computes the same rows.

SQL bodies name adapter frames as ``{frame}``; every frame used, directly or through
another frame, becomes a common table expression.  Three shorthands keep the texts short:
``TS(x)`` formats a timestamp, ``H60(x)`` is the first 60 bits of an md5, ``B(x)`` casts to BIGINT.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.lake import FRAMES, TABLES, Lake
from tidemark.session import apply_job_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PLACEHOLDER = re.compile(r"\{([a-z_]\w*)\}")


def _close(text: str, start: int) -> int:
    depth = 0
    for index in range(start, len(text)):
        depth += {"(": 1, ")": -1}.get(text[index], 0)
        if depth == 0:
            return index
    raise ValueError("unbalanced shorthand")


def _shorthand(text: str, name: str, render: Callable[[str], str]) -> str:
    pattern = re.compile(rf"\b{name}\(")
    while match := pattern.search(text):
        end = _close(text, match.end() - 1)
        text = text[: match.start()] + render(text[match.end() : end]) + text[end + 1 :]
    return text


def compose(body: str) -> str:
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _PLACEHOLDER.findall(text):
            if name in FRAMES and name not in ordered:
                visit(FRAMES[name].sql)
                ordered.append(name)

    visit(body)

    def bind(text: str) -> str:
        return _PLACEHOLDER.sub(lambda m: m.group(1), text)

    unknown = {n for n in _PLACEHOLDER.findall(body) if n not in FRAMES and n not in TABLES}
    if unknown:
        raise KeyError(f"unknown frames {unknown}")
    ctes = [f"{name} AS ({bind(FRAMES[name].sql)})" for name in ordered]
    text = bind(body).strip()
    if ctes:
        if opening := re.match(r"WITH(\s+RECURSIVE)?\s", text):
            text = opening.group(0) + ",\n".join(ctes) + ",\n" + text[opening.end() :]
        else:
            text = "WITH " + ",\n".join(ctes) + "\n" + text
    text = re.sub(r"(?<!['\w])at(?!['\w])", '"at"', text)  # a reserved word only in the second engine
    text = _shorthand(text, "TS", lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')")
    text = _shorthand(text, "H60", lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)")
    return _shorthand(text, "B", lambda x: f"CAST({x} AS BIGINT)")


def query(name: str, sql: str | None = None):
    """Decorator: ``fn(lake) -> DataFrame`` becomes ``queries()[name]``."""

    def register(fn: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Lake(apply_job_conf(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = compose(sql)
        return fn

    return register
