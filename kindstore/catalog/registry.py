"""Registry of queries, and SQL assembled from shared common table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """Define a named common table expression."""
    PARTS[name] = sql.strip()


def _needed(sql: str, done: list[str]) -> list[str]:
    for name in PARTS:
        if name not in done and re.search(rf"(?:FROM|JOIN|[\w)],)\s+{name}\b", sql):
            _needed(PARTS[name], done)
            if name not in done:
                done.append(name)
    return done


def assemble(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{PARTS[n]}\n)" for n in names) + "\n" + sql.strip()


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin."""

    def register(fn):
        from kindstore.catalog.fixtures import Tables

        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = assemble(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison (and no negative zero)."""
    columns = [
        (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ]
    return df.select(*columns)


def u(text: str) -> str:
    """SQL twin of ``functions.scalars.uniform``."""
    return f"(CAST('0x'||substr(md5({text}),1,6) AS BIGINT)/16777215.0)"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"
