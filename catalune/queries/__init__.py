"""Registered queries: each a Spark plan and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}
MODULES = ["scalars", "lists", "reports", "sequences", "matching", "hierarchy", "changes", "making", "signals", "further"]


class Tables:
    """The driver's tables by attribute; each read is lazy and pruned by what the query selects."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, ops: str, sql: str | None = None):
    """Registers f(tables) under a name, with the operators it stands for."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        OPERATORS[name] = ops
        if sql:
            ORACLE[name] = sql
        return f

    return put


for _m in MODULES:
    try:
        import_module(f"catalune.queries.{_m}")
    except ModuleNotFoundError as e:
        if e.name != f"catalune.queries.{_m}":
            raise
