"""The claim cycle: new packs → ledger → snapshot diff → outbox, once per checkpointed batch."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.plans.claims import claim_diff
from tallyforge.schemas import ACKNOWLEDGEMENTS, ATTEMPTS, CYCLE_REVISIONS, CYCLES, OUTBOX
from tallyforge.sources.ledger import _read, append_ledger, read_ledger

from .outbox import deliver_jsonl, enqueue_notifications, notification_events, notification_state


class PackRefused(RuntimeError):
    """A pack broke the chain or collides; its problems are written, and it is offered again by the next run."""


def _runs(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("run", T.LongType())])


def reject_backdated(batch: DataFrame, previous_known_at: datetime | None, known_at: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows not later than the last cycle, or later than this run, are refused."""
    late = F.col("recorded_at") <= F.lit(previous_known_at).cast("timestamp") if previous_known_at else F.lit(False)
    reason = F.when(late, "backdated").when(F.col("recorded_at") > F.lit(known_at).cast("timestamp"), "after_run")
    judged = batch.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def run_cycle_batch(batch: DataFrame, batch_id: int, root: str, known_at: datetime, valid_at: date, sink: str | None = None, limit: int | None = 10_000) -> None:
    """One cycle over one micro-batch. A committed batch stays as it is and every other write overwrites its own folder, so a replay is harmless.

    With a ``sink``, the ``limit`` oldest pending notifications (all, if it is ``None``) are handed over before the cycle is recorded, in a folder named by the
    run; a stop at any point repeats none of them. A batch that breaks the chain or collides is refused whole: its problems are
    written and the run fails, so that the stream does not move on and offers the mended pack again.
    """
    spark = batch.sparkSession
    cycles = _read(spark, f"{root}/cycles", CYCLES).where(F.col("batch_id") < batch_id)
    previous = cycles.agg(F.max("known_at")).first()[0]
    good, refused = reject_backdated(batch, previous, known_at)
    refused.write.mode("overwrite").parquet(f"{root}/rejects/run={batch_id}")
    done = append_ledger(spark, root, "revisions", CYCLE_REVISIONS, good, f"b{batch_id}")
    if not done["committed"]:
        done["problems"].write.mode("overwrite").parquet(f"{root}/problems/run={batch_id}")
        raise PackRefused(f"batch {batch_id}: see {root}/problems/run={batch_id}")
    ledger = read_ledger(spark, root, "revisions", CYCLE_REVISIONS, until=known_at).drop("recorded_date")
    changes = claim_diff(ledger, valid_at, previous or datetime(1970, 1, 1), known_at)
    outbox = _read(spark, f"{root}/outbox", _runs(OUTBOX)).where(F.col("run") < batch_id).drop("run")
    fresh, collisions = enqueue_notifications(notification_events(changes, F.lit(known_at).cast("timestamp")), outbox)
    fresh.write.mode("overwrite").parquet(f"{root}/outbox/run={batch_id}")
    collisions.write.mode("overwrite").parquet(f"{root}/collisions/run={batch_id}")
    if sink is not None:
        events = _read(spark, f"{root}/outbox", _runs(OUTBOX)).where(F.col("run") <= batch_id).drop("run")
        attempts = _read(spark, f"{root}/attempts", _runs(ATTEMPTS)).where(F.col("run") < batch_id).drop("run")
        state = notification_state(events, attempts, _read(spark, f"{root}/acknowledgements", ACKNOWLEDGEMENTS))
        deliver_jsonl(state.where("status = 'pending'"), sink, f"{root}/attempts", str(known_at), limit, batch_id)
    done = spark.range(1).select(F.lit(known_at).cast("timestamp").alias("known_at"), F.lit(batch_id).cast("bigint").alias("batch_id"))
    done.coalesce(1).write.mode("overwrite").parquet(f"{root}/cycles/run={batch_id}")


def run_cycle(spark: SparkSession, packs: str, root: str, known_at: datetime, valid_at: date, sink: str | None = None, limit: int | None = 10_000) -> None:
    """Process every pack file that arrived since the last checkpoint, then stop."""
    stream = spark.readStream.schema(CYCLE_REVISIONS).parquet(packs)
    query = (
        stream.writeStream.foreachBatch(lambda df, i: run_cycle_batch(df, i, root, known_at, valid_at, sink, limit))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def add_filings(batch: DataFrame, batch_id: int, target: str, schema: T.StructType, day: str | None = None) -> None:
    """Add the accessions of a batch that no earlier run has written; a replay overwrites its own folder.

    ``day`` names the filing date, of which an accession has one. The target is then partitioned by it, and only the dates between
    the batch's first and last are read.
    """
    spark = batch.sparkSession
    key = ["accession_number", day] if day else ["accession_number"]
    known = _read(spark, target, _runs(schema)).where(F.col("run") < batch_id)
    if day:
        first, last = batch.agg(F.min(day), F.max(day)).first()
        known = known.where(F.col(day).between(F.lit(first), F.lit(last)) | F.col(day).isNull())
    seen = [F.col(c).eqNullSafe(F.col(f"_known_{c}")) for c in key]
    once = batch.dropDuplicates(["accession_number"]).alias("b")
    fresh = once.join(known.select(*[F.col(c).alias(f"_known_{c}") for c in key]), seen, "left_anti")
    writer = fresh.write.mode("overwrite")
    (writer.partitionBy(day) if day else writer).parquet(f"{target}/run={batch_id}")


def filing_stream(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, day: str | None = None) -> None:
    """Emit each accession once, however often its file is delivered. What is written is the only state, so none grows in the stream."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda df, i: add_filings(df, i, target, schema, day))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
