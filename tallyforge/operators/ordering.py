"""Total orders and bounded top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import shared_dir

# Alert severities, most urgent first.
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "info": 3}


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """The place of each row of a sorted frame, from 1 on.

    The sorted partitions are fixed by a checkpoint; one row per partition then tells how many rows lie before it.
    """
    shared_dir(ordered.sparkSession)
    fixed = ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint()
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = fixed.join(sizes.select("_part", "_from", before.alias("_before")), "_part")
    return placed.select(*ordered.columns, (F.col("_before") + F.col("_at") - F.col("_from") + 1).alias(name))


def order_bottlenecks(df: DataFrame, stage: str = "stage_rank", constraint: str = "constraint_id") -> DataFrame:
    return df.orderBy(F.col(stage), F.col("probability").desc(), F.col(constraint))


def severity_rank(severity: str = "severity"):
    rank = F.lit(len(SEVERITY_ORDER))
    for name, position in SEVERITY_ORDER.items():
        rank = F.when(F.col(severity) == name, position).otherwise(rank)
    return rank


def order_alerts(df: DataFrame) -> DataFrame:
    return df.orderBy(severity_rank(), "type", "path", "id")


def order_research_queue(df: DataFrame, owner: list[str]) -> DataFrame:
    return df.orderBy(F.col("research_priority").desc(), *owner, "parameter")


def oldest_pending(events: DataFrame, limit: int | None = 100) -> DataFrame:
    """The oldest pending events; the limit is the delivery batch size. With ``None`` all of them, unordered: nothing is cut, so no sort decides."""
    pending = events.where(F.col("status") == "pending")
    if limit is None:
        return pending
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must lie between 1 and 10000")
    return pending.orderBy("created_at", "event_id").limit(limit)


def order_filings(df: DataFrame) -> DataFrame:
    return df.orderBy("filing_date", "acceptance_datetime", "entity_id", "accession_number")
