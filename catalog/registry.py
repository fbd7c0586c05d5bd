"""Query registry: name -> (Spark callable, SQL text)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _needed(text: str) -> list[str]:
    """SQL views used by ``text``, in dependency order."""
    found: list[str] = []
    open_: set[str] = set()

    def visit(body: str) -> None:
        words = set(re.findall(r"\w+", body))
        for name, sql in SQL_VIEWS.items():
            if name in words and name not in open_:
                open_.add(name)
                visit(sql)
                found.append(name)

    visit(text)
    return found


def with_views(body: str) -> str:
    body = body.strip()
    own = re.sub(r"(?is)^with\s+(recursive\s+)?", "", body, count=1) if re.match(r"(?i)with\b", body) else None
    ctes = [f"{name} AS ({SQL_VIEWS[name]})" for name in _needed(body)]
    if not ctes:
        return body
    head = "WITH RECURSIVE " + ",\n".join(ctes)
    return f"{head},\n{own}" if own is not None else f"{head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def constant_view(columns: str, mapping: dict) -> str:
    """A SELECT over fixed values for use as a SQL view."""

    def lit(x):
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    rows = ", ".join(
        "(" + ", ".join(lit(x) for x in ((k, *v) if isinstance(v, tuple) else (k, v))) + ")" for k, v in mapping.items()
    )
    return f"SELECT * FROM (VALUES {rows}) AS t({columns})"
