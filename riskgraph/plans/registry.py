"""Registry of named queries and their DuckDB oracle SQL.

``@query(name, sql=...)`` registers a callable ``(spark, sf_dir) -> DataFrame``;
the result's double columns are rounded to 6 places at the boundary so
Spark and DuckDB sums compare equal.  Queries without ``sql`` are checked
by rows / invariants only (iterative or learned results)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskgraph.functions.expr import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
DOCS: dict[str, str] = {}


def query(name: str, sql: str | None = None, round_places: int | None = 6):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df, round_places) if round_places is not None else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DOCS[name] = (fn.__doc__ or "").strip().split("\n")[0]
        if sql is not None:
            ORACLES[name] = sql
        return run
    return wrap


def load_all() -> None:
    """Import every query module so its decorators run."""
    from riskgraph.plans import (q_relational, q_graph, q_link, q_metrics,  # noqa: F401
                                 q_algorithms, q_models, q_streaming, q_io)
