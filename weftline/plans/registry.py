"""Queries by name, each with the operators it shows and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, rounds: bool = False) -> Callable[[Query], Query]:
    """Registers a function under its name. Doubles are rounded to DIGITS on both sides, since sums depend on their order; rounds: the function has done so, before pairs go to copies."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df if rounds else df.withColumns({c: F.round(c, DIGITS) for c, t in df.dtypes if t in ("double", "float")})

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(sql: str, *columns: str) -> str:
    """The SQL with double columns rounded like the query's."""
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql
