"""Replace one result's placeholder constraints by another result's output without double counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.aggregates import minimum_confidence, reproduce_distribution
from tallyforge.operators.joins import align_draws, reached_claims, replace_constraints, replaced_twice
from tallyforge.operators.sets import uncovered


def linked_capacities(draws: DataFrame, links: DataFrame, seed: int) -> DataFrame:
    """Aligned source draws as constraint capacities.

    ``draws(source, draw_index, metric, value)``; ``links(source, metric, constraint_id, stage_rank,
    units_per_system, platform_allocation)``. One permutation per source keeps its metrics together.
    """
    order = align_draws(draws.select("source", "draw_index").distinct(), ["source"], seed)
    placed = draws.join(order, ["source", "draw_index"]).join(links, ["source", "metric"])
    value = F.col("value") * F.col("platform_allocation") / F.col("units_per_system")
    return placed.select(F.col("target_index").alias("draw_index"), "constraint_id", "stage_rank", value.alias("equivalents"))


def link_chain(base: DataFrame, draws: DataFrame, links: DataFrame, replaced: DataFrame, seed: int, sources: DataFrame | None = None, chain: DataFrame | None = None) -> DataFrame:
    """Base capacities ``(draw_index, constraint_id, stage_rank, equivalents)`` with the linked ones in place.

    With ``sources(source, synthetic)`` and ``chain(scenario, source)``, the links that sources have among themselves, each row also tells whether it
    is ``synthetic``: its own source is, or any source that one was linked from. Base rows are not.
    """
    placed = replace_constraints(base, replaced, linked_capacities(draws, links, seed), ["constraint_id"])
    if sources is None:
        return placed
    tainted = chain_synthetic(links.select(F.col("constraint_id").alias("scenario"), "source"), sources, chain)
    tainted = tainted.where("synthetic").select(F.col("scenario").alias("constraint_id"), F.lit(True).alias("synthetic"))
    return placed.join(tainted, "constraint_id", "left").withColumn("synthetic", F.coalesce("synthetic", F.lit(False))).select(*placed.columns, "synthetic")


def link_violations(base: DataFrame, replaced: DataFrame, required: DataFrame, absorbed: DataFrame, draws: DataFrame, frozen: DataFrame) -> DataFrame:
    """Double replacement, unknown ids, uncovered resource kinds, draws that do not reproduce their summary."""
    twice = replaced_twice(replaced, ["constraint_id"]).select(F.col("constraint_id").cast("string").alias("key"), F.lit("replaced_twice").alias("code"))
    unknown = replaced.join(base.select("constraint_id").distinct(), "constraint_id", "left_anti").select(
        F.col("constraint_id").cast("string").alias("key"), F.lit("replacement_missing").alias("code")
    ).distinct()
    open_kinds = uncovered(required, absorbed, ["resource_kind"]).select(F.col("resource_kind").alias("key"), F.lit("kind_not_covered").alias("code"))
    differs = reproduce_distribution(draws, frozen, ["source", "metric"], "value").where("NOT reproduced").select(
        F.concat_ws(".", "source", "metric").alias("key"), F.lit("draws_do_not_reproduce").alias("code")
    )
    return twice.unionByName(unknown).unionByName(open_kinds).unionByName(differs)


def link_lineage(links: DataFrame, sources: DataFrame, estimates: DataFrame) -> DataFrame:
    """Posture and confidence of each linked constraint: a synthetic source taints it."""
    confidence = minimum_confidence(estimates, ["source"])
    joined = links.join(sources, "source").join(confidence, "source", "left")
    return joined.withColumn("posture", F.when(F.col("synthetic"), "synthetic").otherwise("modeled"))


def chain_synthetic(links: DataFrame, sources: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """``scenario, synthetic`` for the scenarios of ``links(scenario, source)``: synthetic as soon as one source is, however far up the chain.

    ``sources(source, synthetic)``; ``chain(scenario, source)`` holds the links of sources that are linked scenarios themselves. Taint walks down
    from the synthetic sources, each round from the newly tainted only; circles end.
    """
    texts = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in ("scenario", "source")])
    chained = texts(links if chain is None else chain)
    every = chained if chain is None else texts(links).unionByName(chained)
    synthetic = sources.where("synthetic").select(F.col("source").cast("string").alias("seed_id"))
    down = every.select(F.col("source").alias("claim_id"), F.concat(F.lit("linked:"), "scenario").alias("depends_on"))
    again = chained.select(F.concat(F.lit("linked:"), "scenario").alias("claim_id"), F.col("scenario").alias("depends_on"))
    reached = reached_claims(down.unionByName(again.distinct()), synthetic).select(F.col("claim_id").alias("name"), F.lit(True).alias("_hit")).distinct()
    asked = links.select("scenario").distinct().withColumn("name", F.concat(F.lit("linked:"), F.col("scenario").cast("string")))
    return asked.join(reached, "name", "left").select("scenario", F.coalesce("_hit", F.lit(False)).alias("synthetic"))
