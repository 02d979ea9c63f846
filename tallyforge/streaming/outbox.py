"""Notification outbox: append-only events, attempts and acknowledgements; status is derived."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.values import row_digest
from tallyforge.operators.joins import with_acknowledgements
from tallyforge.operators.ordering import oldest_pending


def notification_events(alerts: DataFrame, created_at) -> DataFrame:
    """Alert rows as outbox events; the payload digest makes a repeated event recognisable.

    An event is many times as large as its alert, so the alerts are dealt out by id first: a task's buffers follow the shuffle's size, not the input split's.
    """
    payload = [c for c in alerts.columns if c != "id"]
    return alerts.repartition("id").select(
        F.concat(F.lit("notification:"), F.col("id").cast("string")).alias("event_id"), row_digest(**{c: c for c in payload}).alias("payload_sha256"),
        F.to_json(F.struct(*payload)).alias("payload_json"), created_at.alias("created_at"),
    )


def enqueue_notifications(events: DataFrame, outbox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New events, and events whose id is known or comes twice with another payload (violations, not stored)."""
    once = events.dropDuplicates(["event_id", "payload_sha256"])
    known = outbox.select("event_id", F.col("payload_sha256").alias("_known"))
    within = once.groupBy("event_id").agg(F.count("*").alias("_n")).where("_n > 1").select("event_id")
    fresh = once.join(known, "event_id", "left_anti").join(within, "event_id", "left_anti")
    against = once.join(known, "event_id").where(F.col("_known") != F.col("payload_sha256")).select("event_id")
    return fresh, against.union(within).distinct()


def notification_state(events: DataFrame, attempts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """pending / delivered / acknowledged from the three tables; nothing is updated in place."""
    delivered = attempts.where(F.col("outcome") == "delivered").groupBy("event_id").agg(F.min("attempted_at").alias("delivered_at"))
    rows = with_acknowledgements(events.join(delivered, "event_id", "left"), acknowledgements)
    status = F.when(F.col("acknowledged_at").isNotNull(), "acknowledged").when(F.col("delivered_at").isNotNull(), "delivered").otherwise("pending")
    return rows.withColumn("status", status)


def deliver_jsonl(state: DataFrame, path: str, attempts_path: str, delivered_at: str, limit: int | None = 100, run: int | None = None) -> None:
    """Write the oldest pending events as JSON lines, then record the attempts; the rest stays pending. A ``limit`` of ``None`` leaves no rest.

    Each delivery has its own folder in the sink and in the attempts, named by ``run`` (by its time if that is not given). A
    delivery that is repeated for one run, on a state without that run's attempts, overwrites what it wrote and repeats nothing.
    """
    name = f"run={run}" if run is not None else f"at={re.sub('[^0-9]', '', delivered_at)}"
    when = F.lit(delivered_at).cast("timestamp")
    batch = oldest_pending(state, limit).select("event_id", "payload_sha256", "payload_json", "created_at", when.alias("delivered_at"))
    early = F.when(F.col("delivered_at") < F.col("created_at"), F.raise_error(F.lit("delivered_at precedes created_at")).cast("timestamp"))
    batch.withColumn("delivered_at", F.coalesce(early, F.col("delivered_at"))).write.mode("overwrite").json(f"{path}/{name}")
    sent = state.sparkSession.read.schema("event_id string, delivered_at timestamp").json(f"{path}/{name}")
    attempt = F.concat(F.lit("delivery:"), F.left(row_digest(event_id="event_id", sink=F.lit(path), attempted_at="attempted_at"), F.lit(32)))
    rows = sent.dropDuplicates(["event_id"]).select("event_id", F.lit("jsonl").alias("sink_kind"), F.col("delivered_at").alias("attempted_at"), F.lit("delivered").alias("outcome"))
    rows.withColumn("attempt_id", attempt).write.mode("overwrite").parquet(f"{attempts_path}/{name}")
