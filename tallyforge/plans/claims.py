"""Claim ledger and claim audit: snapshots, diffs, gate, evidence coverage, revisions, result alerts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.maths import relative_change
from tallyforge.functions.values import assessment_status, content_id, dimension_mismatches, normalized_posture, normalized_range
from tallyforge.operators.aggregates import synthetic_input_count
from tallyforge.operators.joins import apply_revisions, diff_snapshots, eligible_revisions, gap_coverage, match_exactly_one
from tallyforge.operators.ordering import order_alerts
from tallyforge.operators.sets import union_alerts, union_evidence
from tallyforge.operators.windows import latest_revision, top_binding


def claim_snapshot(revisions: DataFrame, cutoffs: list[tuple[str, datetime, date]]) -> DataFrame:
    """Latest asserted revision per claim at each cutoff; validity is applied before ranking."""
    seen = eligible_revisions(revisions, cutoffs).drop("known_at", "valid_at")
    return latest_revision(seen, ["cutoff", "claim_key"])


def claim_diff(revisions: DataFrame, valid_at: date, previous_known_at: datetime, current_known_at: datetime) -> DataFrame:
    """Added, revised and removed claims between two knowledge times, with content-addressed ids.

    Both snapshots come out of one pass over the revisions.
    """
    if current_known_at < previous_known_at:
        raise ValueError("current_known_at cannot precede previous_known_at")
    both = claim_snapshot(revisions, [("previous", previous_known_at, valid_at), ("current", current_known_at, valid_at)])
    wide = both.groupBy("claim_key").agg(
        F.max(F.when(F.col("cutoff") == "previous", F.col("revision_id"))).alias("previous_revision_id"),
        F.max(F.when(F.col("cutoff") == "current", F.col("revision_id"))).alias("current_revision_id"),
    )
    before, after = F.col("previous_revision_id"), F.col("current_revision_id")
    kind = F.when(before.isNull(), "claim_added").when(after.isNull(), "claim_removed").when(before != after, "claim_revised")
    severity = F.when(before.isNull(), "info").when(after.isNull(), "high").otherwise("medium")
    alerts = wide.withColumn("type", kind).where("type IS NOT NULL").withColumn("severity", severity)
    return alerts.withColumn("id", alert_id())


def alert_id():
    return content_id(
        "claim-alert:", 16, type="type", severity="severity", claim_key="claim_key",
        previous="previous_revision_id", current="current_revision_id",
    )


# The kinds of claim alerts.
ALERT_TYPES = ("claim_added", "claim_removed", "claim_revised")


def diff_integrity(diff: DataFrame, declared_count: int) -> DataFrame:
    """Violations: alerts whose id is missing, repeated or not the digest of their content, alerts without a known type, and a wrong count."""
    kinds = F.array(*[F.lit(k) for k in ALERT_TYPES])
    codes = F.array(
        F.when(F.col("id").isNull(), "alert_id_missing").when(~F.col("id").eqNullSafe(alert_id()), "alert_id_mismatch"),
        F.when(~F.coalesce(F.array_contains(kinds, F.col("type")), F.lit(False)), "alert_type_unknown"),
    )
    wrong = diff.select("id", F.explode(F.array_compact(codes)).alias("code"))
    twice = diff.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("alert_id_repeated").alias("code"))
    count = diff.agg(F.count("*").alias("n")).where(F.col("n") != declared_count).select(
        F.lit("diff").alias("id"), F.lit("alert_count_mismatch").alias("code")
    )
    every = wrong.unionByName(twice).unionByName(count)
    return every.select(F.lit("DQ16").alias("check_id"), F.lit("claim_diff").alias("table"), F.coalesce("id", F.lit("")).alias("key"), F.col("code").alias("detail"))


def gate_claims(claims: DataFrame, selections: DataFrame) -> DataFrame:
    """Acceptance, eligibility, blocker codes and the converted range of each selection's claim.

    ``claims(claim_key, revision_id, value_json, unit, posture, confidence, dimensions)``;
    ``selections(selection_id, claim_key, usage, allowed_postures, target_dimensions, source_unit,
    target_unit, multiplier, target_input_path)``.
    """
    fields = ["revision_id", "value_json", "unit", "posture", "confidence", "dimensions"]
    rows = match_exactly_one(selections, claims, ["claim_key"], fields)
    converts = F.col("usage") != "directional_signal"
    unit_ok = F.col("unit").eqNullSafe(F.col("source_unit"))
    rows = rows.withColumn("_range", F.when(converts & unit_ok, normalized_range("value_json", F.col("multiplier"))))
    own = F.array_compact(
        F.array(
            F.when(F.col("matches") != 1, F.lit("claim_not_unique")),
            F.when(~F.array_contains("allowed_postures", F.col("posture")), F.lit("posture_not_allowed")),
            F.when(converts & ~unit_ok, F.lit("source_unit_mismatch")),
            F.col("_range.blocker"),
        )
    )
    mismatched = F.when(F.col("usage") == "constraint_input", dimension_mismatches("dimensions", "target_dimensions")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("blocking_codes", F.coalesce(F.concat(own, mismatched), own))
    accepted = F.size("blocking_codes") == 0
    eligible = accepted & (F.col("usage") == "constraint_input")
    return rows.select(
        "selection_id", "claim_key", "revision_id", "usage", "target_input_path", "blocking_codes",
        accepted.alias("accepted_for_usage"), eligible.alias("eligible_as_constraint"),
        assessment_status(accepted, eligible, "usage").alias("status"),
        F.col("_range.low").alias("low"), F.col("_range.base").alias("base"), F.col("_range.high").alias("high"),
        normalized_posture("posture", "multiplier").alias("posture"), "confidence",
    )


COVERAGE_STATUSES = ("eligible_claim_candidate", "scope_rejected_claim", "rejected_claim", "no_constraint_claim")


def evidence_coverage(gaps: DataFrame, assessments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per gap status and the share of research priority with an eligible claim."""
    rows = gap_coverage(gaps, assessments)
    eligible = F.col("input_status") == "eligible_claim_candidate"
    covered, total = F.sum(F.when(eligible, F.col("research_priority")).otherwise(0.0)), F.sum("research_priority")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("synthetic_inputs"),
        *[F.count_if(F.col("input_status") == s).alias(s) for s in COVERAGE_STATUSES],
        F.when(total == 0, 0.0).otherwise(covered / total).alias("eligible_priority_share"),
    )


def revise_estimates(estimates: DataFrame, accepted: DataFrame, evidence: DataFrame | None = None, claim_evidence: DataFrame | None = None) -> dict[str, DataFrame]:
    """Apply accepted claims to synthetic estimates; audit of what changed and what is still synthetic.

    With ``evidence(scenario_id, id, …)`` of the scenarios and ``claim_evidence(scenario_id, input_path, id, …)`` of the accepted claims, the
    union of both follows: only claims that replaced an estimate bring theirs, equal rows merge, and ``conflict`` marks an id with two contents.
    """
    revised = apply_revisions(estimates, accepted)
    changed = (F.col("low") != F.col("previous_low")) | (F.col("base") != F.col("previous_base")) | (F.col("high") != F.col("previous_high"))
    audit = revised.where("replaced").withColumn("numeric_changed", changed)
    out = {"estimates": revised, "audit": audit, "remaining": synthetic_input_count(revised, ["scenario_id"])}
    if evidence is not None and claim_evidence is not None:
        applied = claim_evidence.join(audit.select("scenario_id", "input_path"), ["scenario_id", "input_path"], "left_semi").drop("input_path")
        out["evidence"] = union_evidence(evidence, applied, key=["scenario_id", "id"])
    return out


def estimate_alerts(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed, unit change, range breach and posture change per estimate path."""
    fields = ("low", "base", "high", "unit", "posture")
    old = previous.select(*keys, "path", F.struct(*fields).alias("old"))
    new = current.select(*keys, "path", F.struct(*fields).alias("new"))
    both = old.join(new, [*keys, "path"], "full")
    same_unit = F.col("old.unit") == F.col("new.unit")
    here = F.col("old").isNotNull() & F.col("new").isNotNull()
    outside = (F.col("new.base") < F.col("old.low")) | (F.col("new.base") > F.col("old.high"))
    found = F.array_compact(
        F.array(
            F.when(F.col("old").isNull(), _alert("estimate_added", "info")),
            F.when(F.col("new").isNull(), _alert("estimate_removed", "high")),
            F.when(here & ~same_unit, _alert("estimate_unit_changed", "critical")),
            F.when(here & same_unit & outside, _alert("estimate_range_breach", "high")),
            F.when(here & same_unit & (F.col("old.posture") != F.col("new.posture")), _alert("estimate_posture_changed", "medium")),
        )
    )
    detail = F.to_json(F.struct(F.col("old"), F.col("new"))).alias("detail")
    return both.select(*keys, "path", detail, F.inline(found))


def _alert(kind: str, severity: str):
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))


def output_alerts(previous: DataFrame, current: DataFrame, keys: list[str], threshold: float = 0.10) -> DataFrame:
    """Median outputs whose relative change reaches the threshold, or cannot be expressed."""
    joined = previous.select(*keys, "path", F.col("p50").alias("old_p50")).join(
        current.select(*keys, "path", F.col("p50").alias("new_p50")), [*keys, "path"]
    )
    rows = joined.withColumn("change", relative_change("old_p50", "new_p50"))
    hit = F.col("change").isNull() | (F.abs("change") >= threshold)
    return rows.where(hit).select(
        *keys, "path", F.to_json(F.struct("old_p50", "new_p50", "change")).alias("detail"),
        F.lit("output_revision").alias("type"), F.lit("medium").alias("severity"),
    )


def bottleneck_alerts(previous: DataFrame, current: DataFrame, keys: list[str], threshold: float = 0.15) -> DataFrame:
    """Changed most-binding constraint, and probability shifts, for stages present in both results."""
    stage = [*keys, "stage"]
    tops = top_binding(previous, stage).select(*stage, F.col("constraint_id").alias("old_top")).join(
        top_binding(current, stage).select(*stage, F.col("constraint_id").alias("new_top")), stage
    )
    path = F.concat(F.lit("bottlenecks."), "stage")
    changed = tops.where("old_top <> new_top").select(
        *keys, path.alias("path"), F.to_json(F.struct("old_top", "new_top")).alias("detail"),
        F.lit("binding_bottleneck_changed").alias("type"), F.lit("critical").alias("severity"),
    )
    both = previous.select(*stage, "constraint_id", F.col("probability").alias("old")).join(
        current.select(*stage, "constraint_id", F.col("probability").alias("new")), [*stage, "constraint_id"], "full"
    )
    shared = both.fillna(0.0, ["old", "new"]).join(tops.select(*stage), stage, "left_semi")
    shifted = shared.where(F.abs(F.col("new") - F.col("old")) >= threshold).select(
        *keys, F.concat(path, F.lit("["), F.col("constraint_id").cast("string"), F.lit("]")).alias("path"),
        F.to_json(F.struct("old", "new")).alias("detail"), F.lit("bottleneck_probability_shift").alias("type"), F.lit("high").alias("severity"),
    )
    return changed.unionByName(shifted)


def revision_alerts(*detected: DataFrame) -> DataFrame:
    """All detectors in one ordered table with content-addressed ids."""
    rows = union_alerts(*detected)
    ided = rows.withColumn("id", content_id("alert:", 16, **{c: c for c in rows.columns}))
    return order_alerts(ided)


__all__ = [
    "claim_snapshot", "claim_diff", "diff_integrity", "gate_claims", "evidence_coverage", "revise_estimates", "estimate_alerts",
    "output_alerts", "bottleneck_alerts", "revision_alerts", "diff_snapshots",
]
