"""Registry of queries: name, function of (spark, sf_dir), and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as BIGINT: what both engines agree on."""

    def cell(c: str, kind: str) -> Column:
        if kind == "double":
            return (F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c)
        return F.col(f"`{c}`").cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(f"`{c}`")

    return df.select(*[cell(c, kind) for c, kind in df.dtypes])
