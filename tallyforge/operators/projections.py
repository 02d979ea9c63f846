"""Projections and filters that reshape rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.maths import col
from tallyforge.session import scratch_path

from .aggregates import SUMMARY_FIELDS

ESTIMATE_FIELDS = ("low", "base", "high", "unit", "posture", "confidence")


def estimates_long(df: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """One audit row per (keys, parameter) from estimate structs held side by side."""
    rows = F.array(*[F.struct(F.lit(p).alias("parameter"), *[F.col(f"{p}.{f}").alias(f) for f in ESTIMATE_FIELDS]) for p in parameters])
    return df.select(*keys, F.inline(rows))


def _labelled(value: Column) -> Column:
    """Identity of a list item: the first of these fields it carries."""
    names = ("id", "stage", "constraint", "resource_id", "platform_id")
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", "string") for n in names])


def flatten_paths(df: DataFrame, keys: list[str], document: str, required: list[str]) -> DataFrame:
    """Walk a JSON document (VARIANT) and return ``(keys, path, node)`` of nodes with all required keys.

    A matching node is not searched further. List items are labelled by their id, else by position.
    Each level opens the containers that the last one left, and is written to the shared folder; a
    node leaves the walk as soon as it is found. The walk ends with the deepest document.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "paths")
    has_all = F.lit(True) if required else F.schema_of_variant("node").startswith("OBJECT")
    for name in required:
        has_all = has_all & F.try_variant_get("node", f"$.{name}", "variant").isNotNull()  # null unless the node is an object
    container = F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)")
    level = df.select(*keys, F.lit("").alias("path"), F.col(document).alias("node"))
    schema = T.StructType([*level.schema.fields, T.StructField("found", T.BooleanType())])
    depth = 0
    while True:
        judged = level.withColumn("found", F.coalesce(has_all, F.lit(False)))
        judged.where(F.col("found") | container).write.parquet(f"{root}/depth={depth}")
        level = spark.read.schema(schema).parquet(f"{root}/depth={depth}").where("not found")
        if level.isEmpty():
            return spark.read.schema(schema).parquet(root).where("found").select(*keys, "path", "node")
        opened = level.lateralJoin(
            spark.tvf.variant_explode_outer(F.col("node").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
        ).where(F.col("_value").isNotNull())
        label = F.coalesce(_labelled(F.col("_value")), F.col("_pos").cast("string"))
        inner = F.when(F.col("_key").isNull(), F.concat(F.col("path"), F.lit("["), label, F.lit("]"))).otherwise(
            F.concat(F.col("path"), F.when(F.col("path") == "", F.lit("")).otherwise(F.lit(".")), F.col("_key"))
        )
        level = opened.select(*keys, inner.alias("path"), F.col("_value").alias("node"))
        depth += 1


def flatten_draw_columns(df: DataFrame, draw_keys: list[str], nested: str, fields: list[str]) -> DataFrame:
    """``MAP<owner, struct>`` per draw → rows ``(draw_keys, column, value)`` with ``owner.metric`` names."""
    entries = df.select(*draw_keys, F.explode(nested).alias("_owner", "_v"))
    wide = entries.select(*draw_keys, "_owner", *[F.col(f"_v.{f}").cast("double").alias(f) for f in fields])
    long = wide.unpivot([*draw_keys, "_owner"], fields, "_metric", "value")
    return long.select(*draw_keys, F.concat_ws(".", "_owner", "_metric").alias("column"), "value")


def distribution_columns(df: DataFrame, prefix: str, struct: str = "distribution") -> DataFrame:
    rest = [c for c in df.columns if c != struct]
    return df.select(*rest, *[F.col(f"{struct}.{f}").alias(f"{prefix}_{f}") for f in SUMMARY_FIELDS])


def as_distribution(df: DataFrame, name: str = "distribution") -> DataFrame:
    rest = [c for c in df.columns if c not in SUMMARY_FIELDS]
    return df.select(*rest, F.struct(*SUMMARY_FIELDS).alias(name))


def filter_filings(filings: DataFrame, watches: DataFrame) -> DataFrame:
    """Filings of each watched entity inside the watch's date window and form list."""
    listed = watches.select(F.col("id").alias("watch_id"), "filing_date_from", "filing_date_to", "forms", F.explode("entities").alias("entity_id"))
    inside = F.col("filing_date").between(F.col("filing_date_from"), F.col("filing_date_to")) & F.array_contains("forms", F.col("form"))
    return filings.join(listed, "entity_id").where(inside).drop("filing_date_from", "filing_date_to", "forms")


def in_capacity_window(as_of, target_date, stage, minimum_as_of, quarter_end) -> Column:
    """Observed inside [minimum, quarter end); operational rows carry no target date, others one before the quarter end."""
    observed = (col(as_of) >= col(minimum_as_of)) & (col(as_of) < col(quarter_end))
    dated = F.coalesce(col(target_date) < col(quarter_end), F.lit(False))
    return observed & F.when(col(stage) == "operational", col(target_date).isNull()).otherwise(dated)


# Which estimate bound and which source quantile each named case uses.
NAMED_CASES = {"bear": ("low", "high", "p10"), "base": ("base", "base", "p50"), "bull": ("high", "low", "p90")}


def named_cases(df: DataFrame) -> DataFrame:
    """Three rows per input row: a ``case`` with its normal and adverse bound and source quantile."""
    cases = F.array(
        *[
            F.struct(F.lit(c).alias("case"), F.lit(n).alias("bound"), F.lit(a).alias("adverse_bound"), F.lit(q).alias("quantile"))
            for c, (n, a, q) in NAMED_CASES.items()
        ]
    )
    return df.select("*", F.inline(cases))


def case_value(estimate: str, bound: str = "bound") -> Column:
    """The bound of an estimate struct named by a column."""
    return (
        F.when(F.col(bound) == "low", F.col(f"{estimate}.low"))
        .when(F.col(bound) == "high", F.col(f"{estimate}.high"))
        .otherwise(F.col(f"{estimate}.base"))
    )


def distribution_to_estimate(df: DataFrame) -> DataFrame:
    """Frozen quantiles → estimate columns; synthetic sources stay synthetic, others become modeled."""
    return df.select(
        "*", F.col("p10").alias("low"), F.col("p50").alias("base"), F.col("p90").alias("high"),
        F.when(F.col("source_synthetic"), "synthetic").otherwise("modeled").alias("posture"),
        F.concat_ws(":", F.lit("linked"), F.col("source"), F.left(F.col("source_digest"), F.lit(12)), F.col("metric")).alias("correlation_group"),
    )


def identity_estimate(df: DataFrame, value: float = 1.0) -> DataFrame:
    v = F.lit(float(value))
    return df.select(
        "*", v.alias("low"), v.alias("base"), v.alias("high"), F.lit("derived").alias("posture"),
        F.lit(None).cast("string").alias("correlation_group"),
    )


def bottlenecks_long(df: DataFrame, keys: list[str], column: str = "bottlenecks", default_stage: str | None = None) -> DataFrame:
    """Differently shaped bottleneck lists → ``(keys, stage, constraint_id, probability)``."""
    item = F.explode(column).alias("_b")
    names = [f.name for f in df.schema[column].dataType.elementType.fields]
    constraint = F.coalesce(*[F.col(f"_b.{n}") for n in ("constraint_id", "resource_id", "constraint") if n in names])
    stage = F.coalesce(*([F.col("_b.stage")] if "stage" in names else []), F.lit(default_stage))
    return df.select(*keys, item).select(*keys, stage.alias("stage"), constraint.alias("constraint_id"), F.col("_b.probability").alias("probability"))


def evidence_from_claims(claims: DataFrame, metadata: DataFrame) -> DataFrame:
    """Evidence edges of claims (``evidence`` array of structs with snapshot_id) as evidence records."""
    return evidence_records(claims, metadata)[0]


def evidence_records(claims: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence records, and what keeps the metadata from describing every and only the claims' snapshots, each once.

    Problems ``(snapshot_id, problem)``: ``metadata_missing``, ``metadata_not_unique``, ``metadata_unused``.
    """
    edges = claims.select("claim_key", F.inline("evidence"))
    used = edges.groupBy("snapshot_id").agg(F.count("*").alias("_edges"))
    known = metadata.groupBy("snapshot_id").agg(F.count("*").alias("_rows"))
    problem = F.when(F.col("_rows").isNull(), "metadata_missing").when(F.col("_edges").isNull(), "metadata_unused").when(F.col("_rows") > 1, "metadata_not_unique")
    judged = used.join(known, "snapshot_id", "full").select("snapshot_id", problem.alias("problem"))
    return edges.join(metadata, "snapshot_id"), judged.where("problem IS NOT NULL")


def flatten_scores(df: DataFrame, struct: str, lists: list[str]) -> DataFrame:
    """Struct fields to columns; list columns pipe-joined."""
    rest = [c for c in df.columns if c != struct]
    flat = df.select(*rest, f"{struct}.*")
    return flat.select(*[F.concat_ws("|", c).alias(c) if c in lists else F.col(c) for c in flat.columns])
