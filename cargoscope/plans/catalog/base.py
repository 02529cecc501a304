"""Registry of queries over the order tables, each with its check in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.plans import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# SQL twins of the derived tables, by name. A body may use any of them.
CTE: dict[str, str] = {}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the derived tables it names, directly or through others."""
    pool = {**CTE, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in pool:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit_name(name)

    def visit_name(name: str) -> None:
        if name not in order:
            for other in pool:
                if other != name and re.search(rf"\b{other}\b", pool[name]):
                    visit_name(other)
            if name not in order:
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} AS (\n{pool[n].strip()}\n)" for n in order)
    return f"WITH RECURSIVE {head}\n{body.strip()}"


def query(name: str, sql: str | None = None):
    """Register ``fn(snapshot)`` under ``name``; ``sql`` is its equivalent, where one exists."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(star.snapshot(spark, folder))
        if sql is not None:
            SQL[name] = with_tables(sql)
        return fn

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Ratios rounded, so that both engines show the same digits."""
    return df.withColumns({x: F.round(F.col(x), digits) for x in cols})
