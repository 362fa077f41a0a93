"""How queries are registered with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, used: tuple[str, ...], make: Callable[..., DataFrame], sql: str | None = None) -> None:
    """``make`` gets the used views as DataFrames, in order."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: make(*(view(spark, sf_dir, n) for n in used))
    if sql is not None:
        ORACLE_SQL[name] = with_views(sql, *used)


def register_path(name: str, table: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    """``make`` gets the session and the path of one of the driver's tables."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: make(spark, f"{sf_dir}/{table}.parquet")
    ORACLE_SQL[name] = sql


def columns(name: str, source: str, keys: tuple[str, ...], made: dict[str, tuple[Callable[[], Column], str]], rows: str | None = None) -> None:
    """A query that adds columns to the keys of a view; each comes with its SQL expression over ``rows``, the view if there are no others."""
    listed = ", ".join([*keys, *(f"{sql} AS {out}" for out, (_, sql) in made.items())])
    register(name, (source,), lambda df: df.select(*keys, *(c().alias(out) for out, (c, _) in made.items())), f"SELECT {listed} FROM {rows or source}")
