"""Registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasteforge.sources import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Named steps of the oracle queries: name -> (names it reads, SQL).
STEPS: dict[str, tuple[tuple[str, ...], str]] = {name: ((), text) for name, text in views.SQL.items()}


def step(name: str, needs: str, text: str) -> None:
    """Define a step that oracle queries can read by name."""
    STEPS[name] = (tuple(needs.split()), text)


def with_steps(needs: str, text: str) -> str:
    """Put the needed steps, and all they need, before a query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in STEPS[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return text
    return "with " + ",\n".join(f"{name} as materialized ({STEPS[name][1]})" for name in ordered) + "\n" + text


def query(name: str, needs: str = "", oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` reads the steps named in ``needs``."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = with_steps(needs, oracle)
        return function

    return register


def ts_text(column: str = "ts") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def ts_sql(column: str = "ts") -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') as {column}"


def rounded(column: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(name)
