"""Data-quality checks. Every check returns rows of one violations table ``(check_id, table, key, detail)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.maths import col
from tallyforge.functions.values import is_sorted_unique

from .skew import union_all

# Allowed enum members.
POSTURES = ("reported", "derived", "modeled", "synthetic")
CLAIM_STATUSES = ("asserted", "retracted")
CAPACITY_BASES = ("nameplate_input", "tool_throughput", "known_good_output", "sellable_output", "platform_allocated")


def _shape(df: DataFrame, check_id: str, table: str, key, detail) -> DataFrame:
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select(F.lit(check_id).alias("check_id"), F.lit(table).alias("table"), col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def flag_rows(df: DataFrame, table: str, key, problems: dict[str, tuple[str, Column]]) -> DataFrame:
    """Row predicates in one narrow pass: ``{detail: (check_id, condition that is wrong)}``."""
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(c).alias("check_id"), F.lit(d).alias("detail"))) for d, (c, bad) in problems.items()])
    )
    rows = df.select(col(key).cast("string").alias("key"), F.inline(found))
    return rows.select("check_id", F.lit(table).alias("table"), "key", "detail")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], check_id: str, table: str, left_name: str, right_name: str) -> DataFrame:
    """Keys that only one of two inputs has: what an inner join of them would drop without a word."""
    a, b = left.select(*keys).distinct().withColumn("_left", F.lit(True)), right.select(*keys).distinct().withColumn("_right", F.lit(True))
    alone = a.join(b, keys, "full").where("_left IS NULL OR _right IS NULL")
    missing = F.when(F.col("_left").isNull(), f"missing_in:{left_name}").otherwise(f"missing_in:{right_name}")
    return _shape(alone, check_id, table, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), missing)


def duplicates(df: DataFrame, table: str, keys: list[str], check_id: str = "DQ1") -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return _shape(counted, check_id, table, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.concat(F.lit("rows:"), F.col("_n").cast("string")))


def missing_reference(child: DataFrame, parent: DataFrame, table: str, key, reference: str, target: str, check_id: str = "DQ2") -> DataFrame:
    lost = child.join(parent.select(F.col(target).alias(reference)), reference, "left_anti")
    return _shape(lost, check_id, table, key, F.concat(F.lit(f"{reference}:"), F.col(reference).cast("string")))


def bad_number(value) -> Column:
    v = col(value)
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def estimate_problems() -> dict[str, tuple[str, Column]]:
    low, base, high = F.col("low"), F.col("base"), F.col("high")
    return {
        "not_finite": ("DQ3", bad_number(low) | bad_number(base) | bad_number(high)),
        "range_not_ordered": ("DQ3", ~((low >= 0) & (low <= base) & (base <= high))),
        "confidence_out_of_range": ("DQ3", ~F.col("confidence").between(0, 1)),
        "ratio_above_one": ("DQ3", (F.col("unit") == "ratio") & (high > 1)),
        "posture_not_allowed": ("DQ6", ~F.col("posture").isin(*POSTURES)),
    }


def unit_disagreement(a: DataFrame, b: DataFrame, table: str, key: str) -> DataFrame:
    joined = a.select(key, F.col("unit").alias("_a")).join(b.select(key, F.col("unit").alias("_b")), key)
    return _shape(joined.where(F.col("_a") != F.col("_b")), "DQ4", table, key, F.concat_ws("<>", "_a", "_b"))


def temporal_problems(pairs: list[tuple[str, str]], strict: bool = False) -> dict[str, tuple[str, Column]]:
    """Each (earlier, later) pair must be in order where both are known."""
    out = {}
    for earlier, later in pairs:
        wrong = F.col(earlier) >= F.col(later) if strict else F.col(earlier) > F.col(later)
        out[f"{earlier}_after_{later}"] = ("DQ5", F.coalesce(wrong, F.lit(False)))
    return out


def topology_mismatch(a: DataFrame, b: DataFrame, table: str, key: str, fields: list[str]) -> DataFrame:
    """Fields in which two versions of a fixed topology differ, and rows that only one of them has."""
    first, second = a.select(key, *fields, F.lit(True).alias("_a")), b.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    joined = first.join(second, key, "full")
    differs = F.concat_ws("|", *[F.when(~F.col(f).eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields])
    differs = F.when(F.col("_a").isNull(), "missing_in:first").when(F.col("_b").isNull(), "missing_in:second").otherwise(differs)
    return _shape(joined.where(differs != ""), "DQ9", table, key, differs)


def synthetic_leaks(rows: DataFrame, scenarios: DataFrame, table: str, key, scenario: str) -> DataFrame:
    """Synthetic rows inside a scenario that claims not to be synthetic."""
    clean = scenarios.where("NOT synthetic").select(scenario)
    return _shape(rows.where(F.col("posture") == "synthetic").join(clean, scenario, "left_semi"), "DQ10", table, key, "synthetic_in_real_scenario")


def unpinned_evidence(evidence: DataFrame, pins: DataFrame, table: str, key: str) -> DataFrame:
    """Non-synthetic evidence must carry the hash of its pinned source."""
    real = evidence.where(F.col("kind") != "synthetic").select(key, F.col("content_hash").alias("_hash"))
    joined = real.join(pins.select(key, F.col("content_hash").alias("_pin")), key, "left")
    return _shape(joined.where(~F.col("_hash").eqNullSafe(F.col("_pin")) | F.col("_hash").isNull()), "DQ11", table, key, "hash_not_pinned")


def basis_problems() -> dict[str, tuple[str, Column]]:
    """Sellable output is already good; platform-allocated output is also qualified and allocated."""
    sold = F.col("capacity_basis").isin("sellable_output", "platform_allocated")
    given = F.col("capacity_basis") == "platform_allocated"
    return {
        "basis_not_allowed": ("DQ12", ~F.col("capacity_basis").isin(*CAPACITY_BASES)),
        "yield_must_be_one": ("DQ12", sold & (F.col("effective_yield") != 1)),
        "shares_must_be_one": ("DQ12", given & ((F.col("qualified_share") != 1) | (F.col("allocation_share") != 1))),
    }


def contract_problems() -> dict[str, tuple[str, Column]]:
    """Quarter end < earliest ≤ expected ≤ revision end; quantiles in order."""
    return {
        "cutoff_is_not_quarter_end": ("DQ13", F.col("cutoff") != F.date_sub(F.add_months(F.trunc("cutoff", "quarter"), 3), 1)),
        "earliest_not_after_cutoff": ("DQ13", F.col("earliest") <= F.col("cutoff")),
        "expected_before_earliest": ("DQ13", F.col("expected") < F.col("earliest")),
        "revision_before_expected": ("DQ13", F.col("revision_end") < F.col("expected")),
        "quantiles_not_ordered": ("DQ13", ~((F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")))),
    }


def fixed_integer_problem() -> dict[str, tuple[str, Column]]:
    b = F.col("base")
    return {"not_a_fixed_positive_integer": ("DQ14", ~((F.col("low") == b) & (b == F.col("high")) & (b == F.floor(b)) & (b > 0)))}


def claim_problems() -> dict[str, tuple[str, Column]]:
    asserted = F.col("status") == "asserted"
    return {
        "status_not_allowed": ("DQ6", ~F.col("status").isin(*CLAIM_STATUSES)),
        "value_present_iff_asserted": ("DQ15", asserted != F.col("value").isNotNull()),
        "valid_to_not_after_valid_from": ("DQ15", F.col("valid_to").isNotNull() & (F.col("valid_to") <= F.col("valid_from"))),
        "confidence_out_of_range": ("DQ15", ~F.col("confidence").between(0, 1)),
        "evidence_missing": ("DQ15", F.col("evidence_count") == 0),
    }


def pack_evidence_problems(revisions: DataFrame, edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Evidence rules of an ingested pack, one violation per edge and rule.

    ``revisions(revision_id, recorded_at)``; ``edges(revision_id, snapshot_id, evidence_role)``;
    ``snapshots(snapshot_id, retrieved_at)``. A revision names a source once per role, every source exists, and none was
    retrieved after the pack was recorded.
    """
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("revision_id", "snapshot_id", "evidence_role")])
    once = edges.groupBy("revision_id", "snapshot_id", "evidence_role").agg(F.count("*").alias("_n"))
    known = once.join(snapshots.select("snapshot_id", "retrieved_at", F.lit(True).alias("_known")), "snapshot_id", "left")
    rows = known.join(revisions.select("revision_id", "recorded_at", F.lit(True).alias("_recorded")), "revision_id", "left")
    return flag_rows(
        rows, "claim_evidence", key,
        {
            "source_and_role_repeated": ("DQ15", F.col("_n") > 1),
            "unknown_source": ("DQ15", F.col("_known").isNull()),
            "unknown_revision": ("DQ15", F.col("_recorded").isNull()),
            "retrieved_after_recording": ("DQ15", F.coalesce(F.col("retrieved_at") > F.col("recorded_at"), F.lit(False))),
        },
    )


def selection_problems() -> dict[str, tuple[str, Column]]:
    n = F.size("claim_ids")
    forecast_fields = F.col("forecast_vintage").isNotNull()
    return {
        "single_needs_one_id": ("DQ17", (F.col("aggregation") == "single") & (n != 1)),
        "sum_needs_two_ids": ("DQ17", (F.col("aggregation") == "sum") & (n < 2)),
        "ids_not_sorted_unique": ("DQ17", ~is_sorted_unique("claim_ids")),
        "forecast_fields_outside_forecast_mode": ("DQ17", forecast_fields != (F.col("mode") == "forecast")),
    }


def family_mismatch(outcomes: DataFrame, links: DataFrame, evidence: DataFrame, table: str, key: str) -> DataFrame:
    """All evidence of an outcome must come from its declared source family."""
    families = links.join(evidence.select("evidence_id", F.col("source_family").alias("_family")), "evidence_id").groupBy(key).agg(
        F.min("_family").alias("_first"), F.max("_family").alias("_last")
    )
    joined = outcomes.select(key, "source_family").join(families, key)
    wrong = (F.col("_first") != F.col("source_family")) | (F.col("_last") != F.col("source_family"))
    return _shape(joined.where(wrong), "DQ18", table, key, "evidence_from_other_family")


def violations(*checks: DataFrame) -> DataFrame:
    return union_all(list(checks))
