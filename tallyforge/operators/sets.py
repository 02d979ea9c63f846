"""Set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.values import row_digest

from .skew import union_all


def union_evidence(*frames: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Union where identical rows merge; ``conflict`` marks an id that came with different contents."""
    both = union_all(list(frames))
    key = [key] if isinstance(key, str) else key
    fields = [c for c in both.columns if c not in key]
    digest = row_digest(**{f: f for f in fields})
    packed = both.select(*key, digest.alias("_d"), F.struct(*fields).alias("_row"))
    merged = packed.groupBy(*key).agg(
        F.min_by("_row", "_d").alias("_row"), (F.min("_d") != F.max("_d")).alias("conflict")
    )
    return merged.select(*key, "_row.*", "conflict")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side; no row means the sets are equal."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = left.join(right, keys, "full")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull()).select(
        *keys, F.when(F.col("_b").isNull(), "left_only").otherwise("right_only").alias("side")
    )


def uncovered(required: DataFrame, absorbed: DataFrame, keys: list[str]) -> DataFrame:
    return required.select(*keys).distinct().join(absorbed.select(*keys), keys, "left_anti")


def union_alerts(*frames: DataFrame) -> DataFrame:
    return union_all(list(frames))


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
