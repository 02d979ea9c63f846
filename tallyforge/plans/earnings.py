"""Production to revenue to earnings per share, per draw or per named case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.maths import safe_ratio
from tallyforge.operators.projections import case_value, named_cases

LINE_INPUTS = (
    "units_per_source_unit", "attributable_share", "beginning_inventory", "ending_inventory", "recognition_share",
    "unit_price_local", "fx_usd_per_local", "gross_margin",
)
COMPANY_INPUTS = ("rest_revenue", "rest_gross_margin", "operating_expenses", "nonoperating_expense", "tax_rate", "diluted_shares")

# Inputs where a high number hurts, so the bear case takes the high bound.
ADVERSE_LINE_INPUTS = ("ending_inventory",)
ADVERSE_COMPANY_INPUTS = ("operating_expenses", "nonoperating_expense", "tax_rate", "diluted_shares")


def line_results(lines: DataFrame) -> DataFrame:
    """Produced, available, shipped and recognised units, revenue and gross profit of each line row."""
    rows = lines.withColumn("produced_units", F.col("source_units") * F.col("units_per_source_unit") * F.col("attributable_share"))
    rows = rows.withColumn("available_units", F.col("beginning_inventory") + F.col("produced_units"))
    rows = rows.withColumn("shipped_units", F.greatest(F.col("available_units") - F.col("ending_inventory"), F.lit(0.0)))
    rows = rows.withColumn("recognized_units", F.col("shipped_units") * F.col("recognition_share"))
    rows = rows.withColumn("revenue_usd", F.col("recognized_units") * F.col("unit_price_local") * F.col("fx_usd_per_local"))
    return rows.withColumn("gross_profit_usd", F.col("revenue_usd") * F.col("gross_margin"))


def earnings_bridge(lines: DataFrame, companies: DataFrame, keys: list[str]) -> DataFrame:
    """Company results per ``keys``: lines summed, rest of company added, tax only on a profit."""
    chain = line_results(lines).groupBy(*keys).agg(
        F.sum("revenue_usd").alias("chain_revenue"), F.sum("gross_profit_usd").alias("chain_gross_profit")
    )
    rows = companies.join(chain, keys, "left").fillna(0.0, ["chain_revenue", "chain_gross_profit"])
    rows = rows.withColumn("total_revenue", F.col("chain_revenue") + F.col("rest_revenue"))
    rows = rows.withColumn("gross_profit", F.col("chain_gross_profit") + F.col("rest_revenue") * F.col("rest_gross_margin"))
    rows = rows.withColumn("operating_income", F.col("gross_profit") - F.col("operating_expenses"))
    rows = rows.withColumn("pretax_income", F.col("operating_income") - F.col("nonoperating_expense"))
    rows = rows.withColumn("tax_expense", F.greatest(F.col("pretax_income"), F.lit(0.0)) * F.col("tax_rate"))
    rows = rows.withColumn("net_income", F.col("pretax_income") - F.col("tax_expense"))
    return (
        rows.withColumn("eps", F.col("net_income") / F.col("diluted_shares"))
        .withColumn("gross_margin", safe_ratio("gross_profit", "total_revenue"))
        .withColumn("chain_revenue_share", safe_ratio("chain_revenue", "total_revenue"))
    )


def with_revisions(bridge: DataFrame) -> DataFrame:
    """Revisions against ``consensus_revenue`` and ``consensus_eps``, in per cent."""
    return bridge.withColumn(
        "revenue_revision_pct", safe_ratio(F.col("total_revenue") - F.col("consensus_revenue"), "consensus_revenue") * 100
    ).withColumn("eps_revision_pct", safe_ratio(F.col("eps") - F.col("consensus_eps"), "consensus_eps") * 100)


def named_case_results(lines: DataFrame, companies: DataFrame, keys: list[str]) -> DataFrame:
    """Bear, base and bull from estimate structs; adverse inputs flip, consensus stays at its base.

    ``lines`` has ``source`` (struct p10/p50/p90) and estimate structs; ``companies`` has estimate
    structs and ``consensus_revenue``/``consensus_eps`` numbers.
    """
    source = (
        F.when(F.col("quantile") == "p10", F.col("source.p10")).when(F.col("quantile") == "p90", F.col("source.p90")).otherwise(F.col("source.p50"))
    )
    pick = lambda name, adverse: case_value(name, "adverse_bound" if name in adverse else "bound").alias(name)
    line_rows = named_cases(lines).select(*keys, "case", source.alias("source_units"), *[pick(n, ADVERSE_LINE_INPUTS) for n in LINE_INPUTS])
    company_rows = named_cases(companies).select(
        *keys, "case", *[pick(n, ADVERSE_COMPANY_INPUTS) for n in COMPANY_INPUTS], "consensus_revenue", "consensus_eps"
    )
    return with_revisions(earnings_bridge(line_rows, company_rows, [*keys, "case"]))
