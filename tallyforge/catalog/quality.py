"""Data-quality checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.dates import quarter_end, quarter_of
from tallyforge.operators import quality as Q
from tallyforge.operators.aggregates import summarize
from tallyforge.operators.projections import evidence_records
from tallyforge.plans.capacity import assembly_pool, opportunity_ranking
from tallyforge.plans.conversion import conservation_errors, supplier_flows, supplier_pool
from tallyforge.plans.filings import rejected_filings
from tallyforge.plans.forecasts import register_forecasts, score_outcomes

from . import query
from .capacity import FLOWS, flows
from .forecasts import contracts


def rows_sql(check: str, table: str, key: str, detail: str, source: str) -> str:
    return f"""SELECT '{check}' AS check_id, '{table}' AS "table", CAST({key} AS VARCHAR) AS key, {detail} AS detail FROM {source}"""


@query(rows_sql("DQ1", "lineitem", "l_orderkey || '|' || l_linenumber", "'rows:' || n", "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)"))
def dq1_duplicates(t):
    return Q.duplicates(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"])


@query(rows_sql("DQ2", "orders", "o_orderkey", "'o_custkey:' || o_custkey", "orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')"))
def dq2_missing_reference(t):
    return Q.missing_reference(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_mktsegment <> 'MACHINERY'"), "orders", "o_orderkey", "o_custkey", "c_custkey")


@query(
    rows_sql("DQ3", "events", "event_id", "'range_not_ordered'", "events WHERE value * 0.9 > value * 2 - 10")
    + " UNION ALL " + rows_sql("DQ3", "events", "event_id", "'not_finite'", "events WHERE event_type = 'error'")
    + " UNION ALL " + rows_sql("DQ3", "events", "event_id", "'range_not_ordered'", "events WHERE event_type = 'error' AND NOT value * 0.9 > value * 2 - 10")
    + " UNION ALL " + rows_sql("DQ3", "events", "event_id", "'confidence_out_of_range'", "events WHERE value > 200")
    + " UNION ALL " + rows_sql("DQ3", "events", "event_id", "'ratio_above_one'", "events WHERE event_type = 'view' AND value * 3 > 1")
    + " UNION ALL " + rows_sql("DQ6", "events", "event_id", "'posture_not_allowed'", "events WHERE event_type = 'signup'")
)
def dq3_dq6_estimates(t):
    v = F.col("value")
    e = t.events.select(
        "event_id", F.when(F.col("event_type") != "error", v * 0.9).alias("low"), F.when(F.col("event_type") != "error", v * 2 - 10).alias("base"), (v * 3).alias("high"),
        (v / 200).alias("confidence"), F.when(F.col("event_type") == "view", "ratio").otherwise("unit").alias("unit"), F.when(F.col("event_type") == "signup", "guessed").otherwise("reported").alias("posture"),
    )
    return Q.flag_rows(e, "events", "event_id", Q.estimate_problems())


@query(rows_sql("DQ4", "part", "p_partkey", "'crate<>unit'", "part WHERE p_type = 'PROMO'"))
def dq4_units_agree(t):
    unit = F.when(F.col("p_type") == "PROMO", "crate").otherwise("unit")
    return Q.unit_disagreement(t.part.select("p_partkey", unit.alias("unit")), t.part.select("p_partkey", F.lit("unit").alias("unit")), "part", "p_partkey")


@query(
    rows_sql("DQ5", "lineitem", "l_orderkey", "'ordered_after_shipped'", "lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate")
    + " UNION ALL " + rows_sql("DQ5", "lineitem", "l_orderkey", "'shipped_after_recorded'", "lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY")
)
def dq5_temporal_order(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", F.to_date("o_orderdate").alias("ordered"), F.to_date("l_shipdate").alias("shipped"), F.date_add(F.to_date("o_orderdate"), 60).alias("recorded")
    )
    return Q.flag_rows(rows, "lineitem", "l_orderkey", Q.temporal_problems([("ordered", "shipped"), ("shipped", "recorded")]))


@query(f"""WITH {FLOWS} SELECT 'DQ7' AS check_id, 'supplier_pool' AS "table", l_returnflag || '|' || l_orderkey AS key,
 CASE l_returnflag WHEN 'A' THEN 'parts_do_not_sum' ELSE 'support_mismatch' END AS detail FROM p WHERE l_returnflag IN ('A', 'N')""")
def dq7_conservation(t):
    f, demand = flows(t)
    totals = supplier_pool(f, demand, ["l_returnflag"], "l_orderkey", "l_suppkey")["totals"]
    broken = totals.withColumn("allocated_stacks", F.col("allocated_stacks") + F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)).withColumn(
        "packages_supported", F.col("packages_supported") + F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)
    )
    return conservation_errors(f, broken, ["l_returnflag", "l_orderkey"])


@query(rows_sql("DQ8", "supplier", "scope", "'rows:' || n", "(SELECT s_nationkey || '-' || (s_acctbal > 0) AS scope, count(*) AS n FROM supplier GROUP BY ALL HAVING count(*) > 1)"))
def dq8_scope_once(t):
    scope = F.concat_ws("-", F.col("s_nationkey").cast("string"), (F.col("s_acctbal") > 0).cast("string"))
    return Q.duplicates(t.supplier.select(scope.alias("capacity_scope_id")), "supplier", ["capacity_scope_id"], "DQ8")


@query(rows_sql("DQ9", "part", "p_partkey", "CASE WHEN p_size = 1 THEN 'missing_in:first' WHEN p_size = 2 THEN 'missing_in:second' ELSE concat_ws('|', CASE WHEN p_size > 40 THEN 'stacks' END, CASE WHEN p_type = 'PROMO' THEN 'dies' END) END", "part WHERE p_size > 40 OR p_type = 'PROMO' OR p_size IN (1, 2)"))
def dq9_topology(t):
    a = t.part.select("p_partkey", F.lit(8).alias("stacks"), F.lit(2).alias("dies"))
    b = t.part.select("p_partkey", F.when(F.col("p_size") > 40, 12).otherwise(8).alias("stacks"), F.when(F.col("p_type") == "PROMO", F.lit(None).cast("int")).otherwise(2).alias("dies"))
    first, second = t.part.where("p_size <> 1").select("p_partkey"), t.part.where("p_size <> 2").select("p_partkey")
    return Q.topology_mismatch(a.join(first, "p_partkey"), b.join(second, "p_partkey"), "part", "p_partkey", ["stacks", "dies"])


@query(rows_sql("DQ10", "lineitem", "l_orderkey", "'synthetic_in_real_scenario'", "lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND s_acctbal >= 0"))
def dq10_synthetic_leaks(t):
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "synthetic").otherwise("reported").alias("posture"))
    scenarios = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).alias("synthetic"))
    return Q.synthetic_leaks(rows, scenarios, "lineitem", "l_orderkey", "l_suppkey")


@query(rows_sql("DQ11", "documents", "doc_id", "'hash_not_pinned'", "documents WHERE lang <> 'de' AND source IN ('src3', 'src4')"))
def dq11_pinned_hashes(t):
    evidence = t.documents.select("doc_id", F.when(F.col("lang") == "de", "synthetic").otherwise("other").alias("kind"), F.when(F.col("source") != "src4", F.sha2("text", 256)).alias("content_hash"))
    pins = t.documents.select("doc_id", F.when(F.col("source") == "src3", F.sha2("lang", 256)).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return Q.unpinned_evidence(evidence, pins, "documents", "doc_id")


@query(
    rows_sql("DQ12", "part", "p_partkey", "'basis_not_allowed'", "part WHERE p_type = 'SMALL'")
    + " UNION ALL " + rows_sql("DQ12", "part", "p_partkey", "'yield_must_be_one'", "part WHERE p_type IN ('PROMO', 'LARGE') AND p_size > 25")
    + " UNION ALL " + rows_sql("DQ12", "part", "p_partkey", "'shares_must_be_one'", "part WHERE p_type = 'LARGE' AND p_size < 10")
)
def dq12_basis_rules(t):
    basis = F.when(F.col("p_type") == "SMALL", "unknown").when(F.col("p_type") == "PROMO", "sellable_output").when(F.col("p_type") == "LARGE", "platform_allocated").otherwise("tool_throughput")
    rows = t.part.select(
        "p_partkey", basis.alias("capacity_basis"), F.when(F.col("p_size") > 25, 0.9).otherwise(1.0).alias("effective_yield"),
        F.when(F.col("p_size") < 10, 0.5).otherwise(1.0).alias("qualified_share"), F.lit(1.0).alias("allocation_share"),
    )
    return Q.flag_rows(rows, "part", "p_partkey", Q.basis_problems())


@query(
    rows_sql("DQ13", "orders", "o_orderkey", "'cutoff_is_not_quarter_end'", "orders WHERE o_orderstatus = 'P'")
    + " UNION ALL " + rows_sql("DQ13", "orders", "o_orderkey", "'earliest_not_after_cutoff'", "orders WHERE o_orderpriority = '1-URGENT'")
    + " UNION ALL " + rows_sql("DQ13", "orders", "o_orderkey", "'expected_before_earliest'", "orders WHERE o_orderpriority = '2-HIGH'")
    + " UNION ALL " + rows_sql("DQ13", "orders", "o_orderkey", "'revision_before_expected'", "orders WHERE o_orderpriority = '3-MEDIUM'")
    + " UNION ALL " + rows_sql("DQ13", "orders", "o_orderkey", "'quantiles_not_ordered'", "orders WHERE o_totalprice > 400000")
)
def dq13_outcome_contract(t):
    end, p = quarter_end(quarter_of("o_orderdate")), F.col("o_orderpriority")
    cutoff = F.when(F.col("o_orderstatus") == "P", F.date_sub(end, 1)).otherwise(end)
    rows = t.orders.select(
        "o_orderkey", cutoff.alias("cutoff"), F.when(p == "1-URGENT", cutoff).otherwise(F.date_add(end, 20)).alias("earliest"),
        F.when(p == "2-HIGH", F.date_add(end, 10)).otherwise(F.date_add(end, 60)).alias("expected"), F.when(p == "3-MEDIUM", F.date_add(end, 30)).otherwise(F.date_add(end, 90)).alias("revision_end"),
        F.lit(1.0).alias("p10"), F.when(F.col("o_totalprice") > 400000, 0.5).otherwise(2.0).alias("p50"), F.lit(3.0).alias("p90"),
    )
    return Q.flag_rows(rows, "orders", "o_orderkey", Q.contract_problems())


@query(rows_sql("DQ14", "part", "p_partkey", "'not_a_fixed_positive_integer'", "part WHERE p_size % 2 = 1 OR p_type = 'PROMO'"))
def dq14_fixed_integers(t):
    base = F.col("p_size") / 2.0
    rows = t.part.select("p_partkey", base.alias("low"), base.alias("base"), F.when(F.col("p_type") == "PROMO", base + 1).otherwise(base).alias("high"))
    return Q.flag_rows(rows, "part", "p_partkey", Q.fixed_integer_problem())


@query(
    rows_sql("DQ15", "events", "event_id", "'value_present_iff_asserted'", "events WHERE event_type = 'error' AND value > 50")
    + " UNION ALL " + rows_sql("DQ15", "events", "event_id", "'valid_to_not_after_valid_from'", "events WHERE event_type = 'view' AND value > 80")
    + " UNION ALL " + rows_sql("DQ15", "events", "event_id", "'confidence_out_of_range'", "events WHERE value > 100")
    + " UNION ALL " + rows_sql("DQ15", "events", "event_id", "'evidence_missing'", "events WHERE event_type = 'click'")
    + " UNION ALL " + rows_sql("DQ6", "events", "event_id", "'status_not_allowed'", "events WHERE event_type = 'signup'")
    + " UNION ALL " + rows_sql("DQ15", "events", "event_id", "'value_present_iff_asserted'", "events WHERE event_type = 'signup'")
    + " UNION ALL " + rows_sql("DQ1", "claims", "user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)", "'rows:' || count(*)", "events GROUP BY user_id, CAST(ts AS DATE) HAVING count(*) > 1")
)
def dq15_claim_contract(t):
    kind, day = F.col("event_type"), F.to_date("ts")
    rows = t.events.select(
        "event_id", "user_id", F.when(kind == "error", "retracted").when(kind == "signup", "maybe").otherwise("asserted").alias("status"),
        F.when((kind != "error") | (F.col("value") > 50), F.col("value")).alias("value"), day.alias("valid_from"),
        F.when(kind == "view", F.when(F.col("value") > 80, day).otherwise(F.date_add(day, 1))).alias("valid_to"), (F.col("value") / 100).alias("confidence"),
        F.when(kind == "click", 0).otherwise(1).alias("evidence_count"),
    )
    return Q.violations(Q.flag_rows(rows, "events", "event_id", Q.claim_problems()), Q.duplicates(rows, "claims", ["user_id", "valid_from"]))


_EDGES = """(SELECT l_orderkey || '|' || l_suppkey || '|' || l_returnflag AS key, count(*) AS n, any_value(s_suppkey) IS NULL AS lost, any_value(o_orderkey) IS NULL AS unrecorded,
  any_value(DATE '1992-01-01' + CAST(s_nationkey * 90 AS INTEGER)) > any_value(CAST(o_orderdate AS DATE)) AS late
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' GROUP BY l_orderkey, l_suppkey, l_returnflag)"""


@query(
    rows_sql("DQ15", "claim_evidence", "key", "'source_and_role_repeated'", f"{_EDGES} WHERE n > 1")
    + " UNION ALL " + rows_sql("DQ15", "claim_evidence", "key", "'unknown_source'", f"{_EDGES} WHERE lost")
    + " UNION ALL " + rows_sql("DQ15", "claim_evidence", "key", "'unknown_revision'", f"{_EDGES} WHERE unrecorded")
    + " UNION ALL " + rows_sql("DQ15", "claim_evidence", "key", "'retrieved_after_recording'", f"{_EDGES} WHERE NOT lost AND NOT unrecorded AND late")
)
def dq15_pack_evidence(t):
    """Lines as edges from orders (revisions) to suppliers (snapshots)."""
    revisions = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("revision_id"), F.to_date("o_orderdate").alias("recorded_at"))
    edges = t.lineitem.select(F.col("l_orderkey").alias("revision_id"), F.col("l_suppkey").alias("snapshot_id"), F.col("l_returnflag").alias("evidence_role"))
    retrieved = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("s_nationkey") * 90).cast("int"))
    snapshots = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("snapshot_id"), retrieved.alias("retrieved_at"))
    return Q.pack_evidence_problems(revisions, edges, snapshots)


@query(
    rows_sql("DQ17", "part", "p_partkey", "'single_needs_one_id'", "part WHERE p_size < 25 AND p_type <> 'SMALL'")
    + " UNION ALL " + rows_sql("DQ17", "part", "p_partkey", "'sum_needs_two_ids'", "part WHERE p_size >= 25 AND p_type = 'SMALL'")
    + " UNION ALL " + rows_sql("DQ17", "part", "p_partkey", "'ids_not_sorted_unique'", "part WHERE p_type <> 'SMALL' AND p_brand >= p_type")
    + " UNION ALL " + rows_sql("DQ17", "part", "p_partkey", "'forecast_fields_outside_forecast_mode'", "part WHERE p_type = 'PROMO'")
)
def dq17_selection_policy(t):
    rows = t.part.select(
        "p_partkey", F.when(F.col("p_size") < 25, "single").otherwise("sum").alias("aggregation"), F.when(F.col("p_type") == "SMALL", F.array("p_brand")).otherwise(F.array("p_brand", "p_type")).alias("claim_ids"),
        F.when(F.col("p_type") == "PROMO", "v1").alias("forecast_vintage"), F.lit("capacity").alias("mode"),
    )
    return Q.flag_rows(rows, "part", "p_partkey", Q.selection_problems())


@query(rows_sql("DQ18", "customer", "c_custkey", "'evidence_from_other_family'", "customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN customer k ON k.c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW' OR c_mktsegment = 'MACHINERY')"))
def dq18_evidence_family(t):
    outcomes = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "other").otherwise("5-LOW").alias("source_family"))
    links = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("evidence_id"))
    evidence = t.orders.select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("source_family"))
    return Q.family_mismatch(outcomes, links, evidence, "customer", "c_custkey")


def unmatched_sql(check: str, table: str, key: str, left: str, right: str, left_name: str, right_name: str) -> str:
    """Keys of one side only, by set differences."""
    return f"""SELECT '{check}' AS check_id, '{table}' AS "table", CAST(k AS VARCHAR) AS key, detail FROM (
 SELECT k, 'missing_in:{right_name}' AS detail FROM (SELECT {key} AS k FROM {left} EXCEPT SELECT {key} FROM {right})
 UNION ALL SELECT k, 'missing_in:{left_name}' FROM (SELECT {key} AS k FROM {right} EXCEPT SELECT {key} FROM {left}))"""


@query(unmatched_sql("CO4", "supplier_pool", "l_returnflag || '|' || l_orderkey", "lineitem WHERE l_discount < 0.05", "lineitem WHERE l_quantity > 10", "flows", "demand"))
def co4_unmatched_draws(t):
    """Draws with supply and no demand, or the other way round."""
    pool = t.lineitem.where("l_discount < 0.05").select("l_returnflag", "l_orderkey", "l_suppkey", F.col("l_quantity").alias("good_stacks"), F.lit(0.9).alias("qualified_share"), F.lit(0.8).alias("allocation_share"))
    demand = t.lineitem.where("l_quantity > 10").groupBy("l_returnflag", "l_orderkey").agg(F.sum("l_quantity").alias("package_demand"), F.lit(2.0).alias("stacks_per_accelerator"))
    return supplier_pool(supplier_flows(pool), demand, ["l_returnflag"], "l_orderkey", "l_suppkey")["unmatched"]


@query(unmatched_sql("CO5", "assembly_pool", "l_orderkey", "lineitem WHERE l_tax > 0.03", "orders WHERE o_orderstatus <> 'P'", "flows", "demand").replace("SELECT l_orderkey FROM orders", "SELECT o_orderkey FROM orders").replace("SELECT l_orderkey AS k FROM orders", "SELECT o_orderkey AS k FROM orders"))
def co5_unmatched_draws(t):
    """Draws with assembly flows and no rack demand, or the other way round."""
    demand = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(8.0).alias("rack_demand"))
    flows_ = t.lineitem.where("l_tax > 0.03").select("l_orderkey", F.col("l_quantity").alias("assembly_racks"))
    components = t.lineitem.where("l_tax > 0.03").select("l_orderkey", F.col("l_linestatus").alias("component_id"), F.col("l_quantity").alias("allocated_output"), F.lit(2.0).alias("units_per_rack"))
    return assembly_pool(flows_, components, demand, [], "l_orderkey")[1]


@query(unmatched_sql("CO10", "opportunity_ranking", "s_suppkey", "supplier WHERE s_acctbal > 0", "supplier WHERE s_nationkey > 3", "consensus", "factors"))
def co10_unmatched_companies(t):
    """Companies without consensus or without screening factors."""
    company = t.supplier.where("s_acctbal > 0 OR s_nationkey > 3").select(F.lit(1).alias("draw"), "s_suppkey", "s_acctbal", "s_nationkey")
    revenues, factors = company.select("draw", "s_suppkey", F.col("s_acctbal").alias("revenue")), company.where("s_nationkey > 3").select("s_suppkey", F.lit(0.5).alias("confidence"))
    consensus = company.where("s_acctbal > 0").select("draw", "s_suppkey", F.col("s_acctbal").alias("consensus_revenue"))
    return opportunity_ranking(revenues, consensus, factors, ["draw"], "s_suppkey")[1]


@query("""SELECT 'CO14' AS check_id, 'outcomes' AS "table", CAST(k AS VARCHAR) AS key, 'missing_in:forecasts' AS detail
FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate < DATE '1995-01-01')""")
def co14_unknown_forecasts(t):
    """Outcomes of forecasts that were never frozen."""
    outcomes = t.part.select(F.col("p_partkey").alias("forecast_id"), F.col("p_retailprice").alias("actual_value"), F.lit("at_least").alias("operator"), F.lit(20.0).alias("threshold"))
    frozen = t.lineitem.where("l_shipdate < DATE '1995-01-01'").groupBy(F.col("l_partkey").alias("forecast_id")).agg(
        F.min("l_quantity").alias("p10"), F.avg("l_quantity").alias("p50"), F.max("l_quantity").alias("p90")
    )
    return score_outcomes(frozen, outcomes)["unknown"]


@query(unmatched_sql("CO16", "forecast_register", "o_orderkey", "orders", "lineitem WHERE l_quantity > 25", "contracts", "draws").replace("SELECT o_orderkey FROM lineitem", "SELECT l_orderkey FROM lineitem").replace("SELECT o_orderkey AS k FROM lineitem", "SELECT l_orderkey AS k FROM lineitem"))
def co16_contracts_without_draws(t):
    draws = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("forecast_id"), F.col("l_quantity").alias("value"))
    return register_forecasts(draws, summarize(draws, ["forecast_id"], "value"), contracts(t), "1999-02-01")[1]


@query("""SELECT 'P20' AS check_id, 'claim_evidence' AS "table", CAST(k AS VARCHAR) AS key, 'missing_in:metadata' AS detail
FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def p20_edges_without_metadata(t):
    """Evidence edges whose snapshot has no metadata."""
    claims = t.orders.select(F.col("o_orderkey").alias("claim_key"), F.array(F.struct(F.col("o_custkey").alias("snapshot_id"))).alias("evidence"))
    lost = evidence_records(claims, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("snapshot_id")))[1].where("problem = 'metadata_missing'")
    return lost.select(F.lit("P20").alias("check_id"), F.lit("claim_evidence").alias("table"), F.col("snapshot_id").cast("string").alias("key"), F.lit("missing_in:metadata").alias("detail"))


@query("""SELECT o_custkey AS snapshot_id, 'metadata_missing' AS problem FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL
UNION ALL SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'metadata_not_unique' ELSE 'metadata_unused' END FROM customer
 WHERE c_acctbal > 0 AND (c_nationkey = 3 OR c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def p20_metadata_problems(t):
    """Metadata must describe every and only the snapshots of the claims, each once."""
    claims = t.orders.select(F.col("o_orderkey").alias("claim_key"), F.array(F.struct(F.col("o_custkey").alias("snapshot_id"))).alias("evidence"))
    metadata = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("snapshot_id"), "c_nationkey")
    return evidence_records(claims, metadata.union(metadata.where("c_nationkey = 3")))[1]


@query("""SELECT 'CO23' AS check_id, 'filings' AS "table", CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderkey AS VARCHAR) ELSE 'x' || o_orderkey END AS key,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'array_lengths_differ' ELSE 'invalid_accession' END AS detail FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def co23_rejected_filings(t):
    number = F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.format_string("%010d-%02d-%06d", F.col("o_custkey"), F.lit(24), F.col("o_orderkey") % 1000000))
    forms = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F")))
    sources = t.orders.select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("cik"), F.lit("company").alias("company_name"), F.array(number).alias("accession_number"), forms.alias("form"))
    return rejected_filings(sources, ["accession_number", "form"])
