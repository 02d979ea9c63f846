"""Wafer, die, stack and package arithmetic; supplier pools; linked supplier pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.maths import gross_dies_per_wafer, is_close, negative_binomial_yield, safe_ratio
from tallyforge.operators.aggregates import reproduce_distribution
from tallyforge.operators.quality import topology_mismatch, unmatched
from tallyforge.operators.skew import union_all

from .capacity import row_binding

BRANCHES = ("logic_binned_dies", "hbm_good_stacks", "package_assembly_starts")


def logic_branch(df: DataFrame) -> DataFrame:
    rows = df.withColumn(
        "logic_gross_dies_per_wafer",
        gross_dies_per_wafer("logic_diameter", "logic_edge", "logic_width", "logic_height", "logic_scribe"),
    )
    area = F.col("logic_width") * F.col("logic_height")
    rows = rows.withColumn("logic_defect_yield", negative_binomial_yield("defect_density", area, "clustering_alpha"))
    rows = rows.withColumn("logic_gross_dies", F.col("logic_wafer_starts") * F.col("logic_gross_dies_per_wafer"))
    rows = rows.withColumn("logic_known_good_dies", F.col("logic_gross_dies") * F.col("logic_defect_yield") * F.col("sort_yield"))
    rows = rows.withColumn("logic_binned_dies", F.col("logic_known_good_dies") * F.col("bin_share"))
    return rows.withColumn("logic_package_equivalents", F.col("logic_binned_dies") / F.col("logic_dies_per_accelerator"))


def hbm_branch(df: DataFrame) -> DataFrame:
    rows = df.withColumn(
        "hbm_gross_dies_per_wafer", gross_dies_per_wafer("hbm_diameter", "hbm_edge", "hbm_width", "hbm_height", "hbm_scribe")
    )
    rows = rows.withColumn("hbm_known_good_dies", F.col("hbm_wafer_starts") * F.col("hbm_gross_dies_per_wafer") * F.col("known_good_die_yield"))
    rows = rows.withColumn("hbm_raw_stacks", F.col("hbm_known_good_dies") / F.col("memory_dies_per_stack"))
    return rows.withColumn("hbm_good_stacks", F.col("hbm_raw_stacks") * F.col("stack_assembly_yield") * F.col("stack_test_yield"))


def package_stage(df: DataFrame) -> DataFrame:
    """Packages from the scarcest of logic dies, memory stacks and assembly starts, with surplus and use."""
    rows = df.withColumn("hbm_package_equivalents", F.col("hbm_good_stacks") / F.col("stacks_per_accelerator"))
    candidates = dict(zip(BRANCHES, (F.col("logic_package_equivalents"), F.col("hbm_package_equivalents"), F.col("assembly_starts"))))
    rows = rows.withColumn("binding", row_binding(candidates)).withColumn("package_attempts", F.col("binding.value"))
    tried = F.col("package_attempts")
    dies, stacks = tried * F.col("logic_dies_per_accelerator"), tried * F.col("stacks_per_accelerator")
    return (
        rows.withColumn("finished_packages", tried * F.col("assembly_yield"))
        .withColumn("complete_systems", F.col("finished_packages") / F.col("accelerators_per_system"))
        .withColumn("hbm_gb_per_accelerator", F.col("stack_capacity_gb") * F.col("stacks_per_accelerator"))
        .withColumn("memory_dies_per_accelerator", F.col("memory_dies_per_stack") * F.col("stacks_per_accelerator"))
        .withColumn("surplus_logic_dies", F.greatest(F.col("logic_binned_dies") - dies, F.lit(0.0)))
        .withColumn("surplus_hbm_stacks", F.greatest(F.col("hbm_good_stacks") - stacks, F.lit(0.0)))
        .withColumn("logic_utilization", safe_ratio(dies, "logic_binned_dies"))
        .withColumn("hbm_utilization", safe_ratio(stacks, "hbm_good_stacks"))
        .withColumn("assembly_utilization", safe_ratio(tried, "assembly_starts"))
    )


CONVERSION_METRICS = (
    "logic_gross_dies_per_wafer", "logic_defect_yield", "logic_gross_dies", "logic_known_good_dies", "logic_binned_dies",
    "logic_package_equivalents", "hbm_good_stacks", "hbm_package_equivalents", "package_attempts", "finished_packages",
    "complete_systems", "surplus_logic_dies", "surplus_hbm_stacks", "logic_utilization", "hbm_utilization", "assembly_utilization",
)


def wafer_conversion(df: DataFrame) -> DataFrame:
    """One wide row per (scenario, draw); only row arithmetic, so no shuffle."""
    return package_stage(hbm_branch(logic_branch(df)))


def supplier_flows(df: DataFrame) -> DataFrame:
    """Good → qualified → allocated stacks of each supplier row."""
    rows = df.withColumn("qualified_stacks", F.col("good_stacks") * F.col("qualified_share"))
    rows = rows.withColumn("allocated_stacks", F.col("qualified_stacks") * F.col("allocation_share"))
    return rows.withColumn("unqualified_stacks", F.col("good_stacks") - F.col("qualified_stacks")).withColumn(
        "allocated_elsewhere", F.col("qualified_stacks") - F.col("allocated_stacks")
    )


def pool_totals(flows: DataFrame, demand: DataFrame, keys: list[str]) -> DataFrame:
    """Pool numbers per draw: capacity, supported packages, shortfall, use and concentration.

    ``keys`` name one draw of a scenario; ``demand(keys, package_demand, stacks_per_accelerator)``.
    """
    sums = flows.groupBy(*keys).agg(
        F.sum("good_stacks").alias("good_stacks"), F.sum("qualified_stacks").alias("qualified_stacks"),
        F.sum("allocated_stacks").alias("allocated_stacks"), F.sum(F.pow("allocated_stacks", F.lit(2.0))).alias("_squares"),
        F.max("allocated_stacks").alias("_largest"),
    )
    rows = sums.join(demand, keys).withColumn("package_capacity", F.col("allocated_stacks") / F.col("stacks_per_accelerator"))
    rows = rows.withColumn("packages_supported", F.least("package_capacity", "package_demand"))
    consumed = F.col("packages_supported") * F.col("stacks_per_accelerator")
    demanded = F.col("package_demand") * F.col("stacks_per_accelerator")
    return (
        rows.withColumn("demanded_stacks", demanded)
        .withColumn("unfilled_package_demand", F.greatest(F.col("package_demand") - F.col("package_capacity"), F.lit(0.0)))
        .withColumn("excess_stacks", F.greatest(F.col("allocated_stacks") - demanded, F.lit(0.0)))
        .withColumn("fill_fraction", safe_ratio(consumed, "allocated_stacks"))
        .withColumn("hhi", safe_ratio("_squares", F.col("allocated_stacks") * F.col("allocated_stacks")))
        .withColumn("largest_share", safe_ratio("_largest", "allocated_stacks"))
        .withColumn("limited", F.col("package_capacity") < F.col("package_demand"))
        .drop("_squares", "_largest")
    )


def supplier_pool(flows: DataFrame, demand: DataFrame, scenario: list[str], draw: str, supplier: str) -> dict[str, DataFrame]:
    """Totals per draw, consumption per supplier row, single-source criticality, and draws that only flows or only demand have."""
    keys = [*scenario, draw]
    totals = pool_totals(flows, demand, keys)
    per = flows.join(totals.select(*keys, "fill_fraction", "demanded_stacks", F.col("allocated_stacks").alias("_pool")), keys, "left")
    per = per.withColumn("consumed_stacks", F.col("allocated_stacks") * F.col("fill_fraction")).withColumn(
        "allocated_share", safe_ratio("allocated_stacks", "_pool")
    )
    missed = (F.col("_pool") - F.col("allocated_stacks") < F.col("demanded_stacks")).cast("double")
    critical = per.groupBy(*scenario, supplier).agg(F.avg(missed).alias("criticality_probability"))
    alone = unmatched(flows, demand, keys, "CO4", "supplier_pool", "flows", "demand")
    return {"totals": totals, "suppliers": per.drop("_pool"), "criticality": critical, "unmatched": alone}


def conservation_errors(flows: DataFrame, totals: DataFrame, keys: list[str], rel: float = 1e-12, absolute: float = 1e-8) -> DataFrame:
    """Draws whose supplier parts do not add up, or whose demand and support do not follow from them."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")
    return conservation_codes(flows, totals, keys, rel, absolute).select(F.lit("DQ7").alias("check_id"), F.lit("supplier_pool").alias("table"), key, "detail")


def conservation_codes(flows: DataFrame, totals: DataFrame, keys: list[str], rel: float = 1e-12, absolute: float = 1e-8) -> DataFrame:
    """``(keys, detail)``: one row per draw and rule it breaks."""
    parts = flows.groupBy(*keys).agg(F.sum("allocated_stacks").alias("_parts"))
    joined = totals.join(parts, keys, "full")
    ok = lambda a, b: F.coalesce(is_close(a, b, rel, absolute), F.lit(False))
    codes = F.array(
        F.when(~ok("_parts", "allocated_stacks"), "parts_do_not_sum"),
        F.when(~ok("demanded_stacks", F.col("package_demand") * F.col("stacks_per_accelerator")), "demand_mismatch"),
        F.when(~ok("packages_supported", F.least("package_capacity", "package_demand")), "support_mismatch"),
    )
    return joined.select(*keys, F.explode(F.array_compact(codes)).alias("detail"))


def link_supplier_pool(conversion: DataFrame, pool_draws: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the aggregate memory branch by aligned supplier draws ``(keys, allocated_stacks)``.

    The pool draws must already be paired with the target draws (``align_draws``).
    """
    logic = logic_branch(conversion)
    linked = logic.join(pool_draws.select(*keys, F.col("allocated_stacks").alias("hbm_good_stacks")), keys)
    return package_stage(linked)


#: Numbers of a platform that a supplier pool and the conversion must share.
TOPOLOGY = ("memory_dies_per_stack", "stack_capacity_gb", "stacks_per_accelerator")


def admit_pool_draws(flows: DataFrame, totals: DataFrame, frozen: DataFrame, platforms: DataFrame, pool_platforms: DataFrame, scenario: str, draw: str) -> tuple[DataFrame, DataFrame]:
    """Pool draws ``(scenario, draw, allocated_stacks)`` of clean scenarios, and why the others are refused.

    ``flows(scenario, draw, allocated_stacks)`` are supplier rows and ``totals`` the pool's numbers per draw; ``frozen(scenario, metric, six numbers)``
    are the stated distributions of columns of ``totals``; both platform tables hold ``scenario`` and ``TOPOLOGY``. A scenario is admitted
    only if its draws reproduce every stated distribution (A14), every draw conserves (DQ7) and both platforms agree (DQ9). No stated
    distribution at all refuses it too. Refused: ``(scenario, check_id, detail, rows)``, ``rows`` being the draws or numbers that break the rule.
    """
    keys = [scenario, draw]
    metrics = [c for c in ("allocated_stacks", "package_capacity", "packages_supported") if c in totals.columns]
    long = totals.unpivot([scenario], metrics, "metric", "value")
    stated = frozen.select(scenario, "metric").distinct()
    checked = reproduce_distribution(long.join(stated, [scenario, "metric"], "left_semi"), frozen, [scenario, "metric"], "value").where("NOT reproduced")
    differs = checked.select(scenario, F.lit("A14").alias("check_id"), F.concat_ws("|", F.col("metric"), F.array_join("mismatched_fields", "|")).alias("detail"))
    silent = totals.select(scenario).distinct().join(stated, scenario, "left_anti").select(scenario, F.lit("A14").alias("check_id"), F.lit("no_stated_distribution").alias("detail"))
    broken = conservation_codes(flows, totals, keys).select(scenario, F.lit("DQ7").alias("check_id"), "detail")
    shape = topology_mismatch(platforms, pool_platforms, "platform", scenario, list(TOPOLOGY))
    named = platforms.select(scenario).union(pool_platforms.select(scenario)).distinct().withColumn("key", F.col(scenario).cast("string"))
    moved = shape.join(named, "key").select(scenario, "check_id", "detail")
    refused = union_all([differs, silent, broken, moved]).groupBy(scenario, "check_id", "detail").agg(F.count("*").alias("rows"))
    return totals.select(*keys, "allocated_stacks").join(refused.select(scenario), scenario, "left_anti"), refused


def link_gated_pool(conversion: DataFrame, flows: DataFrame, totals: DataFrame, frozen: DataFrame, pool_platforms: DataFrame, scenario: str, draw: str) -> dict[str, DataFrame]:
    """The conversion on admitted supplier draws, the refused scenarios, and admitted draws that only one side has.

    The conversion's own platform is read off its rows, so a scenario whose rows disagree among themselves is refused as well.
    """
    platforms = conversion.select(scenario, *TOPOLOGY).distinct()
    admitted, refused = admit_pool_draws(flows, totals, frozen, platforms, pool_platforms, scenario, draw)
    own = conversion.join(refused.select(scenario), scenario, "left_anti")
    alone = unmatched(own, admitted, [scenario, draw], "CO12", "supplier_link", "conversion", "pool")
    return {"linked": link_supplier_pool(own, admitted, [scenario, draw]), "refused": refused, "unmatched": alone}
