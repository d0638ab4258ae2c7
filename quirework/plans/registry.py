"""The registry of queries: name -> plan over tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[Callable[[str], DataFrame]], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Plan) -> Plan:
        PLANS[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n(c="*"):
    return F.count(c).cast("bigint")
