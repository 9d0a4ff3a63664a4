"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain output types: zone-less times, long counts, arrays of text joined by ``|``."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind in ("int", "smallint"):
            c = c.cast("bigint")
        elif kind == "float":
            c = c.cast("double")
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register
