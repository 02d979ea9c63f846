"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.maths import is_close, safe_ratio

from .skew import exact_quantiles

SUMMARY_FIELDS = ("p10", "p50", "p90", "mean", "minimum", "maximum")


def summarize(df: DataFrame, keys: list[str], value: str, bounded: bool = False) -> DataFrame:
    """The six distribution numbers per group, quantiles interpolated linearly.

    ``bounded=True`` states that a group holds a limited number of rows (one scenario's draws), so
    the one-pass ``percentile`` is used; otherwise groups may have any size.
    """
    if not bounded:
        out = exact_quantiles(df, keys, value, (0.1, 0.5, 0.9))
        return out.select(
            *keys, F.col("_p0").alias("p10"), F.col("_p1").alias("p50"), F.col("_p2").alias("p90"),
            "mean", "minimum", "maximum",
        )
    v = F.col(value).cast("double")
    return (
        df.groupBy(*keys)
        .agg(
            F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"),
            F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        )
        .select(
            *keys, F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p90"),
            "mean", "minimum", "maximum",
        )
    )


def summarize_columns(df: DataFrame, keys: list[str], columns: list[str], bounded: bool = False) -> DataFrame:
    """``summarize`` of many metric columns at once, as rows ``(keys, metric, six numbers)``."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "metric", "_value")
    return summarize(long, [*keys, "metric"], "_value", bounded)


def stage_minimum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("stage_minimum"))


def binding_credit(df: DataFrame, draw_keys: list[str], value: str, rel: float, absolute: float) -> DataFrame:
    """Adds ``group_minimum`` and ``credit``: 1 shared equally by the rows tied with the minimum.

    A draw holds one row per constraint of its scenario, so the window partitions are small.
    """
    w = Window.partitionBy(*draw_keys)
    tied = F.when(is_close(value, F.col("group_minimum"), rel, absolute), 1.0).otherwise(0.0)
    return (
        df.withColumn("group_minimum", F.min(value).over(w))
        .withColumn("_tied", tied)
        .withColumn("credit", F.col("_tied") / F.sum("_tied").over(w))
        .drop("_tied")
    )


def binding_probability(
    df: DataFrame, scenario_keys: list[str], draw_key: str, constraint: str, value: str,
    rel: float = 1e-10, absolute: float = 1e-12,
) -> DataFrame:
    """Share of draws each constraint binds; ties share the credit, shares sum to 1 per scenario key."""
    credited = binding_credit(df, [*scenario_keys, draw_key], value, rel, absolute)
    per = credited.groupBy(*scenario_keys, constraint).agg(F.sum("credit").alias("_credit"))
    total = Window.partitionBy(*scenario_keys)
    return per.select(
        *scenario_keys, constraint, (F.col("_credit") / F.sum("_credit").over(total)).alias("probability")
    )


def sum_ranges(df: DataFrame, keys: list[str], reported: Column, otherwise: str = "derived") -> DataFrame:
    """Sum low/base/high; lowest confidence; reported only if every row is."""
    return df.groupBy(*keys).agg(
        F.sum("low").alias("low"), F.sum("base").alias("base"), F.sum("high").alias("high"),
        F.min("confidence").alias("confidence"),
        F.when(F.every(reported), "reported").otherwise(otherwise).alias("posture"),
        F.count("*").alias("parts"),
    )


def unit_guarded_mean(value: str, unit: str = "unit") -> Column:
    """Mean of raw values only where the group has a single unit."""
    return F.when(F.min(unit) == F.max(unit), F.avg(value))


def concentration(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Herfindahl index and largest share per group, 0 for a zero total."""
    moments = df.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.sum(F.col(value) * F.col(value)).alias("_squares"),
        F.max(value).alias("_largest"),
    )
    return moments.select(
        *keys, "total",
        safe_ratio("_squares", F.col("total") * F.col("total")).alias("hhi"),
        safe_ratio("_largest", "total").alias("largest_share"),
    )


def single_source_criticality(df: DataFrame, draw_keys: list[str], scenario_keys: list[str], supplier: str, value: str, demand: str) -> DataFrame:
    """Share of draws in which the pool without one supplier misses demand.

    The draw total is an aggregate joined back, so a draw with very many suppliers is no single task.
    """
    totals = df.groupBy(*draw_keys).agg(F.sum(value).alias("_total"))
    missed = (F.col("_total") - F.col(value) < F.col(demand)).cast("double")
    return (
        df.join(totals, draw_keys, "left")
        .withColumn("_missed", missed)
        .groupBy(*scenario_keys, supplier)
        .agg(F.avg("_missed").alias("criticality_probability"), F.count("*").alias("draws"))
    )


def conditional_counts(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Count and rate of rows meeting each named condition."""
    aggs = [F.count("*").alias("row_count")]
    for name, condition in flags.items():
        aggs += [F.count_if(condition).alias(f"{name}_count"), F.avg(condition.cast("double")).alias(f"{name}_rate")]
    return df.groupBy(*keys).agg(*aggs)


def weighted_share(df: DataFrame, keys: list[str], weight: str, condition: Column) -> DataFrame:
    covered = F.sum(F.when(condition, F.col(weight)).otherwise(0.0))
    return df.groupBy(*keys).agg(
        F.sum(weight).alias("total_weight"), covered.alias("covered_weight"),
        safe_ratio(covered, F.sum(weight)).alias("weighted_share"),
    )


def event_probability(draws: DataFrame, events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact share of frozen draws that meet each event ``(operator, threshold)``."""
    met = F.when(F.col("operator") == "at_least", F.col(value) >= F.col("threshold")).otherwise(
        F.col(value) <= F.col("threshold")
    )
    joined = draws.join(events, keys)
    return joined.groupBy(*keys, "operator", "threshold").agg(
        F.avg(met.cast("double")).alias("forecast_probability"), F.count("*").alias("draws")
    )


def status_counts(df: DataFrame, status: str, statuses: list[str]) -> DataFrame:
    """Counts per status with zeros for the absent ones: one partial aggregate, no join."""
    counts = df.agg(*[F.count_if(F.col(status) == s).alias(s) for s in statuses])
    return counts.unpivot([], statuses, "status", "row_count")


def reproduce_distribution(draws: DataFrame, frozen: DataFrame, keys: list[str], value: str, rel=1e-12, absolute=1e-8) -> DataFrame:
    """Recompute the six numbers from the draws and compare them with the frozen ones."""
    again = summarize(draws, keys, value)
    pairs = again.select(*keys, *[F.col(f).alias(f"again_{f}") for f in SUMMARY_FIELDS]).join(frozen, keys, "full")
    differs = [
        F.when(~F.coalesce(is_close(f"again_{f}", f, rel, absolute), F.lit(False)), F.lit(f)) for f in SUMMARY_FIELDS
    ]
    return pairs.withColumn("mismatched_fields", F.array_compact(F.array(*differs))).withColumn(
        "reproduced", F.size("mismatched_fields") == 0
    )


def minimum_confidence(estimates: DataFrame, keys: list[str]) -> DataFrame:
    return estimates.groupBy(*keys).agg(F.min("confidence").alias("minimum_confidence"))


def limited_share(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c.cast("double")).alias(n) for n, c in conditions.items()])


def synthetic_input_count(estimates: DataFrame, keys: list[str]) -> DataFrame:
    return estimates.groupBy(*keys).agg(F.count_if(F.col("posture") == "synthetic").alias("synthetic_inputs"))


def document_term_counts(hits: DataFrame, document: str) -> DataFrame:
    """Hits, hits over the limit and matched terms per document; term names are a fixed short list."""
    return hits.groupBy(document).agg(
        F.sum("hit_count").alias("hit_count"),
        F.sum("truncated_hit_count").alias("truncated_hit_count"),
        F.array_sort(F.collect_set(F.when(F.col("hit_count") > 0, F.col("term_id")))).alias("matched_term_ids"),
    )
