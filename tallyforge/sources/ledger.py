"""Append-only ledger tables as parquet batches.

A batch is written to its own folder and becomes visible by its id in the committed table, so a
failed or repeated write never shows half a batch. Readers join on the committed ids.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.values import CORE_DIMENSIONS, OPTIONAL_DIMENSIONS, dimension_map_errors
from tallyforge.operators.quality import claim_problems, flag_rows, pack_evidence_problems
from tallyforge.operators.skew import chunked_lag, union_all
from tallyforge.session import stored

#: The tables of a pack and what names one of their rows.
PACK_KEYS = {"revisions": ["revision_id"], "edges": ["revision_id", "snapshot_id", "evidence_role"], "snapshots": ["snapshot_id"], "dimensions": ["revision_id", "dimension"]}

COMMITTED = T.StructType([T.StructField("batch_id", T.StringType())])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed_batches(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/committed", COMMITTED)


def read_ledger(spark: SparkSession, root: str, table: str, schema: T.StructType, until: datetime | None = None) -> DataFrame:
    """Rows of the committed batches. ``recorded_date`` is a partition, so only the folders up to the cutoff ``until`` are read."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType()), T.StructField("recorded_date", T.DateType())])
    rows = _read(spark, f"{root}/{table}", full)
    if until is not None:
        rows = rows.where(F.col("recorded_date") <= F.to_date(F.lit(until)))
    return rows.join(committed_batches(spark, root).distinct(), "batch_id", "left_semi").select(*[f.name for f in schema.fields], "recorded_date")


def write_batch(df: DataFrame, root: str, table: str, batch_id: str, recorded: str = "recorded_at") -> None:
    """One batch of a table. The rows of a day are brought together first, so that the files do not multiply with the tasks; a large day keeps several."""
    dated = df.withColumn("recorded_date", F.to_date(recorded)).hint("rebalance", F.col("recorded_date"))
    dated.write.mode("overwrite").partitionBy("recorded_date").parquet(f"{root}/{table}/batch_id={batch_id}")


def commit_batch(spark: SparkSession, root: str, batch_id: str) -> None:
    row = spark.range(1).select(F.lit(batch_id).alias("batch_id"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/committed/id={batch_id}")


def is_committed(spark: SparkSession, root: str, batch_id: str) -> bool:
    return not committed_batches(spark, root).where(F.col("batch_id") == batch_id).isEmpty()


def batch_problems(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Revisions of a new batch that break the chain: ``(revision_id, code)``.

    Only the keys the batch touches are looked at; the predecessor is the latest existing revision
    or the previous one inside the batch.
    """
    touched = existing.join(fresh.select("claim_key").distinct(), "claim_key", "left_semi")
    heads = touched.groupBy("claim_key").agg(F.max(F.struct("recorded_at", "revision_id")).alias("_head"))
    chain = chunked_lag(
        fresh.select("claim_key", "revision_id", "recorded_at", "supersedes_revision_id"), ["claim_key"], ["recorded_at", "revision_id"], None,
        {"_prev_id": "revision_id", "_prev_at": "recorded_at"},
    ).join(heads, "claim_key", "left")
    before = F.coalesce("_prev_id", F.col("_head.revision_id"))
    before_at = F.coalesce("_prev_at", F.col("_head.recorded_at"))
    code = (
        F.when(before.isNull() & F.col("supersedes_revision_id").isNotNull(), "first_revision_supersedes")
        .when(before.isNull(), F.lit(None).cast("string"))
        .when(~F.col("supersedes_revision_id").eqNullSafe(before), "wrong_predecessor")
        .when(F.col("recorded_at") <= before_at, "not_later")
    )
    return chain.select("revision_id", code.alias("code")).where("code IS NOT NULL")


def new_and_colliding(existing: DataFrame, batch: DataFrame, key: list[str], names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct rows, those whose key the ledger lacks, and keys with two contents in the batch or against the ledger.

    The batch meets the ledger once, in one exchange by the key; the marked rows are written, as every check and the append read them.
    """
    once = batch.select(*names).repartition(*key).distinct()
    rest = [n for n in names if n not in key]
    known = existing.select(*key, F.lit(True).alias("_seen"), *[F.col(n).alias(f"_known_{n}") for n in rest])
    other = F.lit(False)
    for n in rest:
        other = other | ~F.col(n).eqNullSafe(F.col(f"_known_{n}"))  # tells apart which field is null
    seen = F.col("_seen").isNotNull()
    marked = stored(once.join(known, key, "left").select(*names, seen.alias("_old"), (seen & other).alias("_other")), "marked")
    twice = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key)
    against = marked.where("_other").select(*key)
    return marked.select(*names), marked.where("NOT _old").select(*names), twice.unionByName(against).distinct()


def append_ledger(spark: SparkSession, root: str, table: str, schema: T.StructType, batch: DataFrame, batch_id: str, check_chain: bool = True) -> dict:
    """All-or-nothing append, idempotent by batch and revision id: nothing is visible unless every new row is valid.

    A committed batch is never written again. A batch that was written but not committed is written anew. One revision id
    with two contents, in the batch or against the ledger, refuses the batch.
    """
    if is_committed(spark, root, batch_id):
        return {"committed": True, "problems": None}
    existing = read_ledger(spark, root, table, schema)
    _, fresh, colliding = new_and_colliding(existing, batch, ["revision_id"], [f.name for f in schema.fields])
    problems = colliding.withColumn("code", F.lit("revision_collision"))
    problems = stored(problems.unionByName(batch_problems(existing, fresh)) if check_chain else problems, "problems")
    if not problems.isEmpty():
        return {"committed": False, "problems": problems}
    write_batch(fresh, root, table, batch_id)
    commit_batch(spark, root, batch_id)
    return {"committed": True, "problems": problems}


def dimension_problems(revisions: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Revisions whose dimensions lack a core name, hold an unknown one or a blank value."""
    entry = F.struct("dimension", F.coalesce("value", F.lit("")).alias("value"))
    lists = dimensions.groupBy("revision_id").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    first = F.filter("_all", lambda e, i: (i == 0) | (F.get("_all", i - 1)["dimension"] != e["dimension"]))  # the smallest value of each name
    maps = lists.select("revision_id", F.map_from_entries(first).alias("_dims"))
    rows = revisions.select("revision_id").distinct().join(maps, "revision_id", "left")
    none = F.create_map().cast("map<string,string>")
    codes = dimension_map_errors(F.coalesce("_dims", none), CORE_DIMENSIONS, OPTIONAL_DIMENSIONS)
    return rows.select(F.lit("dimensions").alias("table"), F.col("revision_id").cast("string").alias("key"), F.explode(codes).alias("code"))


def pack_problems(existing: dict[str, DataFrame], pack: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of each table that the ledger lacks, and every broken rule ``(table, key, code)``.

    Rules: no key has two contents; revisions keep their chain and the claim contract, evidence included; edges name a revision of the
    pack and a snapshot of the pack or the ledger that was retrieved in time; dimensions are complete.
    """
    fresh, whole, found = {}, {}, []
    text = lambda key: F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("key")
    for table, key in PACK_KEYS.items():
        whole[table], fresh[table], colliding = new_and_colliding(existing[table], pack[table], key, pack[table].columns)
        found.append(colliding.select(F.lit(table).alias("table"), text(key), F.lit("collision").alias("code")))
    revisions = whole["revisions"]
    chain = batch_problems(existing["revisions"], fresh["revisions"])
    found.append(chain.select(F.lit("revisions").alias("table"), F.col("revision_id").cast("string").alias("key"), "code"))
    counts = pack["edges"].groupBy("revision_id").agg(F.count("*").alias("evidence_count"))
    judged = revisions.join(counts, "revision_id", "left").fillna(0, ["evidence_count"])
    judged = judged if "value" in judged.columns else judged.withColumn("value", F.col("value_json"))
    found.append(flag_rows(judged, "revisions", "revision_id", claim_problems()).select("table", "key", F.col("detail").alias("code")))
    named = existing["snapshots"].join(pack["edges"].select("snapshot_id").distinct(), "snapshot_id", "left_semi").select("snapshot_id", "retrieved_at")
    sources = pack["snapshots"].select("snapshot_id", "retrieved_at").unionByName(named).groupBy("snapshot_id").agg(F.max("retrieved_at").alias("retrieved_at"))
    found.append(pack_evidence_problems(revisions, pack["edges"], sources).select(F.lit("edges").alias("table"), "key", F.col("detail").alias("code")))
    found.append(dimension_problems(revisions, whole["dimensions"]))
    return fresh, stored(union_all(found), "problems")


def append_pack(spark: SparkSession, root: str, pack: dict[str, DataFrame], batch_id: str) -> dict:
    """All-or-nothing append of a whole pack: one write per table, then one commit that makes all four visible.

    ``pack`` holds the tables of ``PACK_KEYS``. A committed batch is never written again, one that was written without its commit is
    written anew. Edges and dimensions are filed under the day of their revision, snapshots under that of their retrieval.
    """
    if is_committed(spark, root, batch_id):
        return {"committed": True, "problems": None}
    existing = {table: read_ledger(spark, root, table, pack[table].schema) for table in PACK_KEYS}
    fresh, problems = pack_problems(existing, pack)
    if not problems.isEmpty():
        return {"committed": False, "problems": problems}
    when = pack["revisions"].select("revision_id", "recorded_at").repartition("revision_id").distinct()
    write_batch(fresh["revisions"], root, "revisions", batch_id)
    write_batch(fresh["snapshots"], root, "snapshots", batch_id, "retrieved_at")
    for table in ("edges", "dimensions"):
        write_batch(fresh[table].join(when, "revision_id"), root, table, batch_id)
    commit_batch(spark, root, batch_id)
    return {"committed": True, "problems": problems}
