"""Queries by inventory id, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many digits, for comparison with another engine."""
    return df.select(*[F.round(f"`{f.name}`", digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def long_counts(sql: str) -> str:
    """SQL with count_if(x), a 128-bit sum in DuckDB, as count(*) FILTER (WHERE x), which is a long."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + len('count_if('):end - 1]}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> Callable[[Query], Query]:
    """Registers a query. doubles: the columns of its SQL that are rounded as the query's doubles are."""

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            plain = long_counts(sql)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in doubles.split())}) FROM ({plain})" if doubles else plain
        return f

    return register


def chain(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + then
