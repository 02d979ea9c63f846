"""Joins. Strategy is left to the optimizer: sizes are checked against the broadcast threshold at run time."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.maths import col, keyed_uniform, triangular_inverse
from tallyforge.functions.values import row_digest
from tallyforge.session import scratch_path

from .skew import chunked_row_number


def attach_evidence(claims: DataFrame, edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Evidence edges with their snapshot, as one ordered array per revision.

    A revision lists few sources: the claim contract makes (source, role) unique per revision.
    """
    detail = edges.join(snapshots, "snapshot_id")
    fields = ["evidence_role", "snapshot_id", *[c for c in detail.columns if c not in ("revision_id", "evidence_role", "snapshot_id")]]
    nested = detail.groupBy("revision_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("evidence"))
    return claims.join(nested, "revision_id", "left")


def with_acknowledgements(events: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Latest acknowledgement per event."""
    last = acknowledgements.groupBy("event_id").agg(
        F.max("acknowledged_at").alias("acknowledged_at"),
        F.max_by("acknowledged_by", F.struct("acknowledged_at", "acknowledged_by")).alias("acknowledged_by"),
    )
    return events.join(last, "event_id", "left")


def diff_snapshots(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Added, removed and revised keys with their severity."""
    old = previous.select(key, F.col(version).alias(f"previous_{version}"))
    new = current.select(key, F.col(version).alias(f"current_{version}"))
    joined = old.join(new, key, "full")
    before, after = F.col(f"previous_{version}"), F.col(f"current_{version}")
    kind = (
        F.when(before.isNull(), "claim_added").when(after.isNull(), "claim_removed").when(before != after, "claim_revised")
    )
    severity = F.when(before.isNull(), "info").when(after.isNull(), "high").otherwise("medium")
    return joined.withColumn("type", kind).withColumn("severity", severity).where(F.col("type").isNotNull())


def new_rows(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return current.join(previous.select(key), key, "left_anti")


def changed_or_missing(current: DataFrame, previous: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Earlier rows that vanished or whose content changed: each is a violation of an append-only feed."""
    digest = row_digest(**{f: f for f in fields})
    old = previous.select(key, digest.alias("_old"))
    new = current.select(key, digest.alias("_new"))
    joined = old.join(new, key, "left").where(F.col("_new").isNull() | (F.col("_new") != F.col("_old")))
    return joined.select(key, F.when(F.col("_new").isNull(), "missing").otherwise("changed").alias("problem"))


def supporting_evidence(evidence: DataFrame, closure: DataFrame, documents: DataFrame) -> DataFrame:
    """Support rows whose claim is in the closure (a ``claim_id`` column), with their source document."""
    support = evidence.where(F.col("role") == "support").join(closure.select("claim_id"), "claim_id", "left_semi")
    return support.join(documents, "document_id", "left")


def match_exactly_one(left: DataFrame, right: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Payload of the single match per left row, with the match count; a count other than 1 is a violation.

    Only rows of the right side that some left row asks for are grouped.
    """
    asked = right.join(left.select(*keys).distinct(), keys, "left_semi")
    found = asked.groupBy(*keys).agg(F.count("*").alias("matches"), *[F.first(c).alias(c) for c in payload])
    joined = left.join(found, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    single = F.col("matches") == 1
    return joined.select(*left.columns, "matches", *[F.when(single, F.col(c)).alias(c) for c in payload])


def pair_metrics(a: DataFrame, b: DataFrame, key: str, attributes: list[str], value: str) -> DataFrame:
    """Pairs of the same key; attributes that differ are listed."""
    right = b.select(key, F.col(value).alias("actual_value"), *[F.col(c).alias(f"_b_{c}") for c in attributes])
    joined = a.join(right, key)
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in attributes]
    return joined.withColumn("mismatched_attributes", F.array_compact(F.array(*differs))).drop(
        *[f"_b_{c}" for c in attributes]
    )


def _literal_cutoffs(cutoffs: list[tuple[str, datetime, date]]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("cutoff"), F.lit(known).cast("timestamp").alias("known_at"), F.lit(valid).cast("date").alias("valid_at")
            )
            for name, known, valid in cutoffs
        ]
    )


def eligible_revisions(revisions: DataFrame, cutoffs: list[tuple[str, datetime, date]]) -> DataFrame:
    """Revisions known and valid at each of a few (name, known_at, valid_at) cutoffs.

    The cutoffs are literals of the query, so this is a narrow filter and the largest one reaches
    the scan as a pushed-down bound on ``recorded_at``.
    """
    latest = max(known for _, known, _ in cutoffs)
    seen = F.filter(
        _literal_cutoffs(cutoffs),
        lambda c: (F.col("recorded_at") <= c["known_at"])
        & (F.col("valid_from") <= c["valid_at"])
        & (F.col("valid_to").isNull() | (c["valid_at"] < F.col("valid_to"))),
    )
    return (
        revisions.where(F.col("recorded_at") <= F.lit(latest).cast("timestamp"))
        .select("*", F.explode(seen).alias("_c"))
        .select(*revisions.columns, "_c.cutoff", "_c.known_at", "_c.valid_at")
    )


def expand_draws(estimates: DataFrame, draws: int, seed: int) -> DataFrame:
    """Every estimate × draw index with its sampled value.

    The uniform depends on (seed, group or estimate id, draw), so estimates of one correlation group
    share it and partitioning cannot change it.
    """
    shared = F.coalesce(F.col("correlation_group"), F.col("estimate_id").cast("string"))
    indexed = estimates.withColumn("draw_index", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = keyed_uniform(seed, shared, "draw_index")
    return indexed.withColumn("value", triangular_inverse(u, "low", "base", "high"))


def eligible_constraints(constraints: DataFrame, rank: str, last_rank: int, stage: str = "stage_rank") -> DataFrame:
    """A constraint counts at its own stage and every later one; the stages are a short fixed list."""
    return constraints.withColumn(stage, F.explode(F.sequence(F.col(rank), F.lit(last_rank))))


def align_draws(source: DataFrame, keys: list[str], seed: int, index: str = "draw_index") -> DataFrame:
    """One keyed permutation per source: adds ``target_index``, keeping each source row whole.

    Rows are ordered by a hash, whose leading digits split a source into 4096 even chunks.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(index).cast("string"))
    hashed = source.withColumn("_h", F.md5(text))
    chunk = F.conv(F.left(F.col("_h"), F.lit(3)), 16, 10).cast("int")
    numbered = chunked_row_number(hashed, keys, ["_h", index], "_position", chunk)
    return numbered.withColumn("target_index", F.col("_position") - 1).drop("_h", "_position")


def _levels(start: DataFrame, edges: DataFrame, keys: list[str]) -> str:
    """Walk ``edges`` from the rows of ``start`` until nothing new is reached; the folder with one partition per depth.

    A round joins the newest level only and drops what an earlier one holds. Each level is written to the shared folder, so
    a lost executor costs one level at most. Rows already seen are never taken again, so cycles end.
    """
    spark = start.sparkSession
    root = scratch_path(spark, "closure")
    start.select(*keys).distinct().write.parquet(f"{root}/depth=0")
    schema = T.StructType([start.schema[k] for k in keys])
    depth = 0
    while True:
        frontier = spark.read.schema(schema).parquet(f"{root}/depth={depth}")
        if frontier.isEmpty():
            return root
        visited = spark.read.schema(schema).parquet(*[f"{root}/depth={d}" for d in range(depth + 1)])
        step = frontier.join(edges, "claim_id").drop("claim_id").withColumnRenamed("depends_on", "claim_id").select(*keys).distinct()
        step.join(visited, keys, "left_anti").write.parquet(f"{root}/depth={depth + 1}")
        depth += 1


def reached_claims(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The distinct ``claim_id`` that any of ``seeds(seed_id)`` depends on, the seeds included; no pairs are built."""
    root = _levels(seeds.select(F.col("seed_id").alias("claim_id")), edges, ["claim_id"])
    return edges.sparkSession.read.schema(T.StructType([T.StructField("claim_id", seeds.schema["seed_id"].dataType)])).parquet(root)


def closure_per_selection(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """``selection_id, claim_id``: what the claims of each selection depend on, they included. ``selected`` has the same two columns."""
    keys = ["selection_id", "claim_id"]
    root = _levels(selected, edges, keys)
    return edges.sparkSession.read.schema(T.StructType([selected.schema[k] for k in keys])).parquet(root).select(*keys)  # without the levels' depths


def cyclic_claims(edges: DataFrame) -> DataFrame:
    """The distinct ``claim_id`` on a cycle of ``edges``, or between two cycles.

    Edges that end where none begins, or begin where none ends, lie on no cycle; they are dropped, round by round, until all others stay.
    """
    spark = edges.sparkSession
    left = edges.select("claim_id", "depends_on").where("depends_on IS NOT NULL").distinct()
    count, size = -1, None
    while count != size:
        path = scratch_path(spark, "cycle-edges")
        onward = left.join(left.select(F.col("claim_id").alias("depends_on")).distinct(), "depends_on", "left_semi")
        onward.join(onward.select(F.col("depends_on").alias("claim_id")).distinct(), "claim_id", "left_semi").select("claim_id", "depends_on").write.parquet(path)
        left = spark.read.schema(left.schema).parquet(path)
        count, size = size, left.count()
    return left.select("claim_id").distinct()


def claim_closure(edges: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """All claims each selected seed depends on: ``(seed_id, claim_id, depth, reaches_itself, missing)``.

    ``edges(claim_id, depends_on)``; ``seeds`` are the selected ids, not the whole table.
    """
    spark = edges.sparkSession
    start = seeds.select("seed_id", F.col("seed_id").alias("claim_id"))
    schema = T.StructType(start.schema.fields)
    root = _levels(start, edges, ["seed_id", "claim_id"])
    reached = spark.read.schema(T.StructType([*schema.fields, T.StructField("depth", T.IntegerType())])).parquet(root)
    known = nodes.select("claim_id", F.lit(True).alias("_known"))
    cyclic = (
        reached.join(edges, "claim_id")
        .where(F.col("depends_on") == F.col("seed_id"))
        .select("seed_id", F.lit(True).alias("_cyclic"))
        .distinct()
    )
    return (
        reached.join(known, "claim_id", "left")
        .join(cyclic, "seed_id", "left")
        .select(
            "seed_id", "claim_id", "depth",
            F.coalesce("_cyclic", F.lit(False)).alias("reaches_itself"), F.col("_known").isNull().alias("missing"),
        )
    )


def join_dimension(fact: DataFrame, dimension: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return fact.join(dimension, keys, how)


def gap_coverage(gaps: DataFrame, assessments: DataFrame, path: str = "input_path") -> DataFrame:
    """Status of every gap from all constraint assessments of its path; the many side is folded first."""
    folded = assessments.where(F.col("usage") == "constraint_input").groupBy(path).agg(
        F.count("*").alias("assessments"),
        F.bool_or("eligible_as_constraint").alias("_eligible"),
        F.bool_or(F.exists("blocking_codes", lambda c: c.startswith("dimension_mismatch:"))).alias("_scope"),
    )
    status = (
        F.when(F.col("_eligible"), "eligible_claim_candidate")
        .when(F.col("_scope"), "scope_rejected_claim")
        .when(F.col("assessments") > 0, "rejected_claim")
        .otherwise("no_constraint_claim")
    )
    joined = gaps.join(folded, path, "left").withColumn("input_status", status)
    return joined.withColumn("assessments", F.coalesce("assessments", F.lit(0))).drop("_eligible", "_scope")


def replace_constraints(base: DataFrame, replaced: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows without the replaced ids, plus the linked rows."""
    return base.join(replaced.select(*keys).distinct(), keys, "left_anti").unionByName(linked, allowMissingColumns=True)


def replaced_twice(replaced: DataFrame, keys: list[str]) -> DataFrame:
    return replaced.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def apply_revisions(estimates: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replace synthetic estimates at a path; the correlation group of the old estimate is kept."""
    keys = ["scenario_id", "input_path"]
    fields = [c for c in replacements.columns if c not in keys]
    right = replacements.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    hit = F.col("_hit").isNotNull() & (F.col("posture") == "synthetic")
    joined = estimates.join(right, keys, "left").withColumn("replaced", hit)
    out = [F.when(F.col("replaced"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in estimates.columns]
    before = [F.when(F.col("replaced"), F.col(c)).alias(f"previous_{c}") for c in ("low", "base", "high") if c in fields]
    return joined.select(*out, *before, "replaced")


def select_documents(filings: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested filings with their review reason, and the requests that name no known filing."""
    key = "accession_number"
    return filings.join(requests, key), requests.join(filings.select(key), key, "left_anti")
