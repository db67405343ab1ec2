"""Named queries and the SQL that says what each one must return."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumbrera import bindings
from lumbrera.queries.oracle_views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def oracle(sql: str) -> str:
    """``sql`` with the views it reads, and the ones those read, in front as CTEs."""
    known = {**bindings.SQL, **VIEWS}
    needed: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in bindings.references(text, known):
            if name not in needed and name not in path:
                visit(known[name], (*path, name))
                if name not in needed:
                    needed.append(name)

    visit(sql, ())
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Times are UTC by contract, whatever session the caller brings.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add
