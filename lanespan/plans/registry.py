"""Registered queries and, where SQL can state them, their comparison text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """Round computed doubles so both engines print the same value; ``shift`` avoids decimal ties."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(shift), digits) for c in columns})
