"""Queries over the driver tables: each pairs a Spark job with an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[["Tables"], DataFrame]
    sql: str | None


class Tables:
    """Lazy access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its name together with its SQL oracle."""

    def wrap(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query registered twice: {key}")
        REGISTRY[key] = Query(key, fn, sql)
        return fn

    return wrap


def sq(expression: str, places: int = 6) -> str:
    """The SQL form of ``settle``."""
    return f"floor(CAST({expression} AS DOUBLE) * {float(10**places)!r} + 0.3217) / {float(10**places)!r}"


def load() -> dict[str, Query]:
    from tallyforge.catalog import aggregates, capacity, evidence, forecasts, joins, pipeline, quality, scalars  # noqa: F401

    return REGISTRY
