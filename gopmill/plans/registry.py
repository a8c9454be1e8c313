"""The table of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gopmill.plans.adapters import CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_ctes(body: str, *names: str) -> str:
    """``body`` below the named common table expressions and what those need, in order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in CTES[name][0]:
            need(other)
        ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body
    return "WITH RECURSIVE " + ",\n".join(CTES[n][1] for n in ordered) + "\n" + body


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return run

    return register
