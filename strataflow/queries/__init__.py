"""Named queries and, where SQL can say them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 4
#: Added before rounding, so that values halfway between two roundings don't hang on the last bit of a sum.
OFF = 3.1e-7


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def shaped(df: DataFrame, keys: list[str], ints: list[str] = (), doubles: list[str] = ()) -> DataFrame:
    """keys as they are, whole numbers as BIGINT, doubles rounded (and -0 as 0).

    Rounded in binary, as DuckDB does it: F.round() writes every double as a decimal text first."""
    unit = F.lit(float(10**PLACES))
    return df.select(*keys, *(F.col(c).cast("long").alias(c) for c in ints), *((F.rint((F.col(c).cast("double") + F.lit(OFF)) * unit) / unit + F.lit(0.0)).alias(c) for c in doubles))


def shape(inner: str, keys: list[str], ints: list[str] = (), doubles: list[str] = ()) -> str:
    """The same in SQL."""
    parts = [*keys, *(f"CAST({c} AS BIGINT) AS {c}" for c in ints), *(f"round(CAST({c} AS DOUBLE) + CAST({OFF} AS DOUBLE), {PLACES}) + 0.0 AS {c}" for c in doubles)]
    return f"SELECT {', '.join(parts)} FROM ({inner}) AS shaped"


def load() -> None:
    from . import jobs, joins, lookups, matching, models, series  # noqa: F401
