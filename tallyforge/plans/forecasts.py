"""Frozen forecasts: registration, maturity, scoring, scorecards, outcome reviews, guidance backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import maturity_status
from tallyforge.functions.maths import (
    brier, col, event_realized, half_width_scale, interval_miss, pinball, range_position, safe_ratio, triangular_event_probability,
)
from tallyforge.operators.aggregates import conditional_counts, event_probability, reproduce_distribution, unit_guarded_mean
from tallyforge.operators.quality import unmatched
from tallyforge.operators.skew import exact_quantiles

# Postures an outcome may have, and disposition statuses.
OUTCOME_POSTURES = ("reported", "derived")
DISPOSITIONS = ("pending", "unobservable", "not_comparable", "observed")
# Why an outcome cannot be observed, and in what a candidate may differ from its forecast.
UNOBSERVABLE_REASONS = ("no_public_disclosure", "scope_not_disclosed", "source_access_unavailable", "evidence_conflict_unresolved")
MISMATCH_DIMENSIONS = ("entity", "product", "geography", "period", "stage", "quantity_semantics", "aggregation", "unit", "cutoff")


def score_rows(df: DataFrame, probability: Column | None = None) -> DataFrame:
    """Error, coverage, pinball and event scores of rows with p10/p50/p90, actual_value and an event.

    ``probability`` is the exact draw share where one was frozen; by default the quantiles are read
    as a triangle. Rows without an event have a null operator.
    """
    actual = F.col("actual_value")
    rows = df.withColumn("signed_error", F.col("p50") - actual).withColumn("absolute_error", F.abs(F.col("p50") - actual))
    mean_loss = (pinball("p10", actual, 0.1) + pinball("p50", actual, 0.5) + pinball("p90", actual, 0.9)) / 3
    has_event = F.col("operator").isNotNull()
    chance = probability if probability is not None else triangular_event_probability("p10", "p50", "p90", "operator", "threshold")
    return (
        rows.withColumn("inside_p10_p90", actual.between(F.col("p10"), F.col("p90")))
        .withColumn("signed_error_ratio", safe_ratio("signed_error", actual, None))
        .withColumn("actual_to_p50_ratio", safe_ratio(actual, "p50", None))
        .withColumn("interval_miss", interval_miss("p10", "p90", actual))
        .withColumn("normalization_half_width", half_width_scale("p10", "p50", "p90"))
        .withColumn("normalized_absolute_error", F.col("absolute_error") / F.col("normalization_half_width"))
        .withColumn("mean_pinball_loss", mean_loss)
        .withColumn("normalized_mean_pinball_loss", F.col("mean_pinball_loss") / F.greatest(F.abs(actual), F.lit(1e-12)))
        .withColumn("event_probability", F.when(has_event, chance))
        .withColumn("event_realized", F.when(has_event, event_realized("operator", "threshold", actual)))
        .withColumn("brier_score", F.when(has_event, brier("event_probability", "event_realized")))
    )


def score_forecasts(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Join outcomes to their frozen forecast and score each row."""
    return score_outcomes(forecasts, outcomes)["scores"]


def score_outcomes(forecasts: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """Scores, and outcomes whose forecast was never frozen. A forecast without an outcome is pending, not unmatched."""
    alone = unmatched(outcomes, forecasts, ["forecast_id"], "CO14", "outcomes", "outcomes", "forecasts").where("detail = 'missing_in:forecasts'")
    return {"scores": score_rows(outcomes.join(forecasts, "forecast_id")), "unknown": alone}


def scorecard(scores: DataFrame, minimum_group_size: int) -> DataFrame:
    """Overall, per metric class and per source family in one pass, with recalibration proposals.

    Only metric classes may propose: the median actual/p50 ratio and a width multiplier of at least 1.
    """
    sets = F.array(
        F.struct(F.lit("overall").alias("grouping"), F.lit("all").alias("group")),
        F.struct(F.lit("metric_class").alias("grouping"), F.col("metric_class").alias("group")),
        F.struct(F.lit("source_family").alias("grouping"), F.col("source_family").alias("group")),
    )
    rows = scores.select("*", F.inline(sets))
    keys = ["grouping", "group"]
    means = rows.groupBy(*keys).agg(
        F.count("*").alias("forecasts"),
        F.count("actual_to_p50_ratio").alias("_ratios"),
        F.avg(F.col("inside_p10_p90").cast("double")).alias("coverage_rate"),
        unit_guarded_mean("signed_error").alias("mean_signed_error"),
        unit_guarded_mean("absolute_error").alias("mean_absolute_error"),
        F.avg("signed_error_ratio").alias("mean_signed_error_ratio"),
        F.avg(F.abs("signed_error_ratio")).alias("mean_absolute_percentage_error"),
        F.avg("normalized_mean_pinball_loss").alias("mean_normalized_pinball_loss"),
        F.avg("brier_score").alias("mean_brier_score"),
        F.count("brier_score").alias("brier_event_count"),
    )
    return recalibration_proposal(means, scores, keys, minimum_group_size)


def recalibration_proposal(means: DataFrame, scores: DataFrame, keys: list[str], minimum_group_size: int) -> DataFrame:
    long = scores.select("metric_class", "actual_to_p50_ratio", "normalized_absolute_error").unpivot(
        ["metric_class"], ["actual_to_p50_ratio", "normalized_absolute_error"], "_measure", "_value"
    )
    both = exact_quantiles(long, ["metric_class", "_measure"], "_value", (0.5, 0.8))
    proposals = both.groupBy(F.lit("metric_class").alias("grouping"), F.col("metric_class").alias("group")).agg(
        F.max(F.when(F.col("_measure") == "actual_to_p50_ratio", F.col("_p0"))).alias("_ratio"),
        F.max(F.when(F.col("_measure") == "normalized_absolute_error", F.col("_p1"))).alias("_width"),
    )
    joined = means.join(proposals, keys, "left")
    status = (
        F.when(F.col("grouping") != "metric_class", "diagnostic_only")
        .when(F.col("forecasts") < minimum_group_size, "insufficient_history")
        .when(F.col("_ratios") != F.col("forecasts"), "not_estimable_zero_p50")
        .otherwise("holdout_validation_required")
    )
    rows = joined.withColumn("proposal_status", status)
    ready = F.col("proposal_status") == "holdout_validation_required"
    return (
        rows.withColumn(
            "additional_outcomes_needed",
            F.when(F.col("grouping") == "metric_class", F.greatest(F.lit(minimum_group_size) - F.col("forecasts"), F.lit(0))),
        )
        .withColumn("p50_multiplier", F.when(ready, F.col("_ratio")))
        .withColumn("half_width_multiplier", F.when(ready, F.greatest(F.lit(1.0), F.col("_width"))))
        .drop("_ratio", "_width", "_ratios")
    )


def score_guidance(pairs: DataFrame) -> DataFrame:
    """Range coverage, direction and normalised error of guidance (low, midpoint, high) against actual_value."""
    actual = F.col("actual_value")
    rows = pairs.withColumn("signed_error", F.col("midpoint") - actual).withColumn("absolute_error", F.abs(F.col("midpoint") - actual))
    return (
        rows.withColumn("surprise_direction", range_position("low", "high", actual))
        .withColumn("signed_error_ratio", safe_ratio("signed_error", actual, None))
        .withColumn("actual_to_midpoint_ratio", safe_ratio(actual, "midpoint", None))
        .withColumn("interval_miss", interval_miss("low", "high", actual))
        .withColumn("half_width", (F.col("high") - F.col("low")) / 2)
        .withColumn("normalization_scale", half_width_scale("low", "midpoint", "high"))
        .withColumn("normalized_absolute_error", F.col("absolute_error") / F.col("normalization_scale"))
    )


def guidance_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    flags = {n: F.col("surprise_direction") == n for n in ("inside_range", "above_range", "below_range")}
    counts = conditional_counts(scores, keys, flags)
    errors = scores.groupBy(*keys).agg(
        F.avg(F.abs("signed_error_ratio")).alias("mean_absolute_percentage_error"),
        F.avg("normalized_absolute_error").alias("mean_normalized_absolute_error"),
    )
    return counts.join(errors, keys)


def register_forecasts(draws: DataFrame, frozen: DataFrame, contracts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Frozen vintage: quantiles reproduced from the draws, exact event share, maturity and blockers.

    ``draws(forecast_id, value)``, ``frozen(forecast_id, six numbers)``, ``contracts(forecast_id,
    operator, threshold, cutoff, earliest, expected, synthetic)``. The second result names contracts without draws and draws without a contract.
    """
    alone = unmatched(contracts, draws, ["forecast_id"], "CO16", "forecast_register", "contracts", "draws")
    checked = reproduce_distribution(draws, frozen, ["forecast_id"], "value").select("forecast_id", "p10", "p50", "p90", "reproduced")
    shares = event_probability(draws, contracts.select("forecast_id", "operator", "threshold"), ["forecast_id"], "value")
    rows = contracts.join(checked, "forecast_id").join(shares.select("forecast_id", "forecast_probability"), "forecast_id", "left")
    return with_maturity(rows, as_of), alone


def with_maturity(rows: DataFrame, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    rows = rows.withColumn("maturity", maturity_status(day, "cutoff", "earliest", "expected"))
    blockers = F.array(
        F.lit("realized_outcome_not_attached"),
        F.when(F.col("maturity") == "pending_period_end", F.lit("forecast_period_not_ended")),
        F.when(F.col("maturity") == "pending_observation_window", F.lit("outcome_observation_window_not_open")),
        F.when(F.col("maturity") == "outcome_overdue", F.lit("expected_evidence_date_passed")),
        F.when(F.col("synthetic"), F.lit("source_scenario_is_synthetic")),
    )
    return rows.withColumn("calendar_eligible", day >= F.col("earliest")).withColumn("blockers", F.array_compact(blockers))


def review_outcomes(forecasts: DataFrame, dispositions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Exactly one disposition per forecast under the state rules; only observed rows are scored.

    Returns the reviewed rows and the violations ``(forecast_id, code)``.
    """
    day = F.lit(as_of).cast("date")
    counted = dispositions.groupBy("forecast_id").agg(
        F.count("*").alias("_n"), *[F.first(c).alias(c) for c in dispositions.columns if c != "forecast_id"]
    )
    fields = [c for c in counted.columns if c not in ("forecast_id", "_n")]
    joined = forecasts.withColumn("_forecast", F.lit(True)).join(counted.select("forecast_id", "_n", *[F.col(c).alias(f"d_{c}") for c in fields]), "forecast_id", "full")
    status = F.col("d_status")
    code = (
        F.when(F.col("_forecast").isNull(), "unknown_forecast")
        .when(F.col("_n").isNull(), "no_disposition")
        .when(F.col("_n") > 1, "several_dispositions")
        .when(~status.isin(*DISPOSITIONS), "unknown_status")
        .when((status == "pending") & (day > F.col("expected")), "overdue_without_disposition")
        .when((status == "unobservable") & (day <= F.col("expected")), "unobservable_too_early")
        .when(status.isin("not_comparable", "observed") & (day < F.col("earliest")), "window_not_open")
        .when((status == "observed") & ~F.col("d_unit").eqNullSafe(F.col("unit")), "unit_mismatch")
        .when((status == "observed") & ~F.coalesce(F.col("d_actual_value") >= 0, F.lit(False)), "negative_actual")
        .when((status == "observed") & ~F.col("d_posture").isin(*OUTCOME_POSTURES), "posture_not_allowed")
        .when((status == "observed") & ~F.col("d_observed_at").between(F.col("earliest"), day), "observed_outside_window")
    )
    judged = joined.withColumn("code", code)
    calendar = (
        F.when(status == "unobservable", "closed_unobservable")
        .when(status == "not_comparable", "closed_not_comparable")
        .when(status == "observed", "observed_and_scored")
        .when(day <= F.col("cutoff"), "pending_period_end")
        .otherwise("awaiting_outcome")
    )
    good = judged.where("code IS NULL").withColumn("calendar_status", calendar)
    good = good.withColumn("actual_value", F.when(status == "observed", F.col("d_actual_value")))
    scored = score_rows(good, F.col("forecast_probability"))
    return scored.withColumnRenamed("d_status", "disposition"), judged.where("code IS NOT NULL").select("forecast_id", "code")


def review_evidence(dispositions: DataFrame, evidence: DataFrame) -> DataFrame:
    """What the evidence of dispositions lacks: ``(forecast_id, code)``, one row per broken rule.

    ``dispositions(forecast_id, status, reason_code, evidence_ids, mismatch_dimensions, source_family, observed_at,
    reviewed_at)``; ``evidence(evidence_id, source_family, published_at, retrieved_at)``. Only a closed disposition needs
    evidence; only an observed one is held against family and publication.
    """
    status = F.col("status")
    closed, observed = status.isin("not_comparable", "observed"), status == "observed"
    links = dispositions.where(closed).select("forecast_id", "observed_at", "reviewed_at", F.col("source_family").alias("_declared"), F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    known = links.join(evidence.withColumn("_known", F.lit(True)), "evidence_id", "left")
    facts = known.groupBy("forecast_id").agg(
        F.bool_or(F.col("_known").isNull()).alias("_missing"), F.bool_or(F.col("_known") & ~F.col("source_family").eqNullSafe(F.col("_declared"))).alias("_family"),
        F.bool_or(F.col("published_at") > F.col("observed_at")).alias("_published"), F.bool_or(F.col("retrieved_at") > F.col("reviewed_at")).alias("_retrieved"),
    )
    ids, dimensions = F.coalesce("evidence_ids", F.array().cast("array<string>")), F.coalesce("mismatch_dimensions", F.array().cast("array<string>"))
    allowed = F.array(*map(F.lit, MISMATCH_DIMENSIONS))
    rules = {
        "reason_not_supported": (status == "unobservable") & ~F.coalesce(F.col("reason_code").isin(*UNOBSERVABLE_REASONS), F.lit(False)),
        "no_evidence": closed & (F.size(ids) == 0),
        "evidence_repeated": closed & (F.size(F.array_distinct(ids)) < F.size(ids)),
        "evidence_missing": closed & F.col("_missing"),
        "mismatch_dimensions_invalid": (status == "not_comparable") & ((F.size(dimensions) == 0) | (F.size(F.array_except(dimensions, allowed)) > 0)),
        "mismatch_dimensions_repeated": (status == "not_comparable") & (F.size(F.array_distinct(dimensions)) < F.size(dimensions)),
        "family_mismatch": observed & F.col("_family"),
        "observed_before_publication": observed & F.col("_published"),
        "reviewed_before_retrieval": closed & F.col("_retrieved"),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()]))
    return dispositions.join(facts, "forecast_id", "left").select("forecast_id", F.explode(codes).alias("code"))


def review_summary(reviewed: DataFrame) -> DataFrame:
    observed = F.col("disposition") == "observed"
    return reviewed.agg(
        *[F.count_if(F.col("disposition") == s).alias(s) for s in DISPOSITIONS],
        F.avg(F.when(observed, F.col("inside_p10_p90").cast("double"))).alias("interval_coverage_rate"),
    )
