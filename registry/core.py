"""Table of queries: a Spark callable and, where the semantics fit SQL, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.domain import Domain, sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *uses: str) -> Callable[[Callable[[Domain], DataFrame]], Query]:
    """Register ``fn(domain)`` under a name; ``uses`` are the SQL frames the oracle reads."""

    def add(fn: Callable[[Domain], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Domain(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle.strip(), *uses)
        return run

    return add


def num(c: Column | str) -> Column:
    """Number as a double for the comparison; exact decimals up to here."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
