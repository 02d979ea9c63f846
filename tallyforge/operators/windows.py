"""Ordered operators: latest revision, supersession, ranking, water filling, stage chains."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import chunked_lag, chunked_rank, chunked_running, latest_by


def latest_revision(revisions: DataFrame, keys: list[str], keep_retracted: bool = False) -> DataFrame:
    """Newest revision per key; a retraction hides older revisions, so it is dropped after ranking."""
    newest = latest_by(revisions, keys, ["recorded_at", "revision_id"])
    return newest if keep_retracted else newest.where(F.col("status") == "asserted")


def check_supersession(revisions: DataFrame, chunk: Column) -> DataFrame:
    """Problem code per revision: it must name its predecessor and be strictly later."""
    lagged = chunked_lag(
        revisions, ["claim_key"], ["recorded_at", "revision_id"], chunk,
        {"previous_revision_id": "revision_id", "previous_recorded_at": "recorded_at"},
    )
    first = F.col("previous_revision_id").isNull()
    problem = (
        F.when(first & F.col("supersedes_revision_id").isNotNull(), "first_revision_supersedes")
        .when(first, F.lit(None).cast("string"))
        .when(~F.col("supersedes_revision_id").eqNullSafe(F.col("previous_revision_id")), "wrong_predecessor")
        .when(F.col("recorded_at") <= F.col("previous_recorded_at"), "not_later")
    )
    return lagged.withColumn("problem", problem)


def rank_candidates(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    return chunked_rank(df, keys, score, ties)


def top_binding(df: DataFrame, keys: list[str], constraint: str = "constraint_id") -> DataFrame:
    """Most probable constraint per key; equal probabilities are decided by the constraint id."""
    best = F.min_by(F.struct(constraint, "probability"), F.struct(-F.col("probability"), constraint))
    return df.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col(f"_b.{constraint}").alias(constraint), F.col("_b.probability").alias("probability")
    )


def water_fill(
    df: DataFrame, totals: DataFrame, group: list[str], weight: str, cap: str, bounded: bool = False
) -> DataFrame:
    """Weighted shares of a group total, capped, with the remainder spread again over the uncapped.

    Closed form: with rows ordered by cap/weight, the fill level is the largest
    ``(total - caps before) / (weights from here on)`` that lies below the row's own cap/weight.
    Only distinct ratios matter, so they are combined first. ``bounded=True`` states that a group is
    small (the customers of one draw); then two windows do it, with the same result. A group
    without a total is not limited: its rows get their caps.
    """
    active = (F.col(weight) > 0) & (F.col(cap) > 0)
    ratio = F.col(cap) / F.col(weight)
    total = F.when(F.col("total").isNotNull(), F.greatest(F.col("total"), F.lit(0.0)))
    if bounded:
        return _filled(df.join(totals, group, "left"), group, weight, cap).select(*df.columns, "allocated")
    steps = (
        df.where(active)
        .groupBy(*group, ratio.alias("_ratio"))
        .agg(F.sum(cap).alias("_cap"), F.sum(weight).alias("_weight"))
    )
    running = chunked_running(steps, group, ["_ratio"], {"_cap_to": "_cap", "_weight_to": "_weight"})
    sums = steps.groupBy(*group).agg(F.sum("_weight").alias("_all_weight")).join(totals, group)
    level = (total - (F.col("_cap_to") - F.col("_cap"))) / (
        F.col("_all_weight") - (F.col("_weight_to") - F.col("_weight"))
    )
    fills = (
        running.join(sums, group, "left")
        .withColumn("_level", level)
        .groupBy(*group)
        .agg(F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).alias("_fill"))
    )
    rows = df.join(fills, group, "left")
    return rows.select(*df.columns, _share(weight, cap).alias("allocated"))


def _share(weight: str, cap: str) -> Column:
    """What a row gets at its group's ``_fill`` level."""
    share = F.least(F.col(cap), F.coalesce(F.col("_fill") * F.col(weight), F.col(cap)))
    return F.when((F.col(weight) > 0) & (F.col(cap) > 0), F.greatest(share, F.lit(0.0))).otherwise(0.0)


def _filled(rows: DataFrame, group: list[str], weight: str, cap: str) -> DataFrame:
    """``allocated`` of rows that carry their small group's ``total``, all or one of them, by windows over the group."""
    active = (F.col(weight) > 0) & (F.col(cap) > 0)
    limit = F.when(F.col("total").isNotNull(), F.greatest(F.col("total"), F.lit(0.0)))
    w = Window.partitionBy(*group)
    by_ratio = w.orderBy("_ratio")
    rows = rows.withColumn("_ratio", F.when(active, F.col(cap) / F.col(weight)))
    kept_cap = F.when(active, F.col(cap)).otherwise(0.0)
    kept_weight = F.when(active, F.col(weight)).otherwise(0.0)
    before = by_ratio.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = by_ratio.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one order for all: one sort
    rows = rows.withColumns({"_cap_to": F.sum(kept_cap).over(before), "_rest": F.sum(kept_weight).over(after), "_total": F.max(limit).over(all_rows)})
    rows = rows.withColumn("_same", F.sum(kept_cap).over(Window.partitionBy(*group, "_ratio")))
    rows = rows.withColumn("_level", F.when(active, (F.col("_total") - (F.col("_cap_to") - F.col("_same"))) / F.col("_rest")))
    rows = rows.withColumn("_fill", F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(w))
    return rows.withColumn("allocated", _share(weight, cap))


def fill_and_rest(df: DataFrame, totals: DataFrame, group: list[str], weight: str, cap: str) -> DataFrame:
    """The bounded ``water_fill`` and what it leaves, in one pass: rows and totals meet in one exchange and the inputs are computed once.

    Returns ``df`` with ``allocated`` and ``leftover`` (false), and a row per total, null in the columns of ``df`` but ``group``, with what is left as
    ``allocated``. As in a join, a row whose group has a null meets no total.
    """
    blank = {c: F.lit(None).cast(t.dataType) for c, t in zip(df.columns, df.schema) if c not in group}
    limits = totals.select(*group, *[v.alias(c) for c, v in blank.items()], F.col("total").cast("double").alias("_own"), F.lit(True).alias("leftover"))
    rows = df.select(*group, *blank, F.lit(None).cast("double").alias("_own"), F.lit(False).alias("leftover")).unionByName(limits)
    whole = Window.partitionBy(*group)
    known = reduce(and_, [F.col(k).isNotNull() for k in group])
    filled = _filled(rows.withColumn("total", F.when(known, F.col("_own"))), group, weight, cap)
    used = F.when(known, F.sum(F.when(~F.col("leftover"), F.col("allocated"))).over(whole))
    left = F.greatest(F.greatest(F.col("_own"), F.lit(0.0)) - F.coalesce("_used", F.lit(0.0)), F.lit(0.0))
    return filled.withColumn("_used", used).select(*df.columns, F.when(F.col("leftover"), left).otherwise(F.col("allocated")).alias("allocated"), "leftover")


def unallocated(allocations: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    used = allocations.groupBy(*group).agg(F.sum("allocated").alias("_used"))
    left = F.greatest(F.greatest(F.col("total"), F.lit(0.0)) - F.coalesce("_used", F.lit(0.0)), F.lit(0.0))
    return totals.join(used, group, "left").select(*group, left.alias("unallocated"))


def check_contiguous(draws: DataFrame, keys: list[str], index: str = "draw_index") -> DataFrame:
    """The draw index must run 0..n-1 once each: counts decide it, no sort is needed."""
    once = draws.groupBy(*keys, index).agg(F.count("*").alias("_c"))
    return once.groupBy(*keys).agg(
        F.sum("_c").alias("draws"),
        ((F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.max("_c") == 1)).alias("contiguous"),
    )


def cumulative_stage_output(stage_minima: DataFrame, draw_keys: list[str], stage: str, value: str) -> DataFrame:
    """Output can only fall along the chain. A draw has one row per stage."""
    w = Window.partitionBy(*draw_keys).orderBy(stage).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stage_minima.withColumn("stage_output", F.min(value).over(w))


def stage_holdback(outputs: DataFrame, keys: list[str], stage: str, value: str, demand: str) -> DataFrame:
    """Units held between consecutive stages; unfilled demand before the first. One row per stage."""
    w = Window.partitionBy(*keys).orderBy(stage)
    return outputs.withColumn(
        "held_back", F.greatest(F.coalesce(F.lag(value).over(w), F.col(demand)) - F.col(value), F.lit(0.0))
    )


def cap_hits(hits: DataFrame, limit: int) -> DataFrame:
    """Keep the first ``limit`` occurrences; the occurrence number is already part of a hit."""
    if not 1 <= limit <= 500:
        raise ValueError("the hit limit per term and document must lie between 1 and 500")
    return hits.where(F.col("occurrence") <= limit)
