"""Aggregations and ordered operators over the driver tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tallyforge.functions.maths import settle
from tallyforge.operators import aggregates as A
from tallyforge.operators import joins as J
from tallyforge.operators import ordering as O
from tallyforge.operators import projections as P
from tallyforge.operators import windows as W

from . import query, sq

SIX = ("p10", "p50", "p90", "mean", "minimum", "maximum")


def settled(df, names=SIX, places=4):
    return df.select(*[settle(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def six_sql(value: str, places: int = 4) -> str:
    parts = [f"quantile_cont({value}, {q})" for q in (0.1, 0.5, 0.9)] + [f"avg({value})", f"min({value})", f"max({value})"]
    return ", ".join(f"{sq(p, places)} AS {n}" for p, n in zip(parts, SIX))


@query(f"SELECT l_returnflag, {six_sql('l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def a1_summarize(t):
    return settled(A.summarize(t.lineitem, ["l_returnflag"], "l_extendedprice"))


@query(f"SELECT l_partkey, {six_sql('l_quantity')} FROM lineitem GROUP BY l_partkey")
def a1_summarize_many_groups(t):
    return settled(A.summarize(t.lineitem, ["l_partkey"], "l_quantity"))


def constraints(t):
    """Scenario = return flag, draw = order, constraint = line number (also its stage rank)."""
    value = F.col("l_quantity") * (1 - F.col("l_discount")) / (1 + F.col("l_tax"))
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("scenario_id"), F.col("l_orderkey").alias("draw_index"),
        F.col("l_linenumber").alias("constraint_id"),
    ).agg(F.sum(value).alias("equivalents"))


CONSTRAINTS = """c AS (SELECT l_returnflag AS scenario_id, l_orderkey AS draw_index, l_linenumber AS constraint_id,
   sum(l_quantity * (1 - l_discount) / (1 + l_tax)) AS equivalents FROM lineitem GROUP BY ALL)"""


@query(f"WITH {CONSTRAINTS} SELECT scenario_id, draw_index, {sq('min(equivalents)')} AS stage_minimum FROM c GROUP BY ALL")
def a2_stage_minimum(t):
    out = A.stage_minimum(constraints(t), ["scenario_id", "draw_index"], "equivalents")
    return settled(out, ["stage_minimum"], 6)


@query(f"""WITH {CONSTRAINTS}, m AS (SELECT *, min(equivalents) OVER (PARTITION BY scenario_id, draw_index) AS low FROM c),
 k AS (SELECT *, CASE WHEN abs(equivalents - low) <= greatest(1e-10 * greatest(abs(equivalents), abs(low)), 1e-12) THEN 1.0 ELSE 0.0 END AS tied FROM m),
 g AS (SELECT scenario_id, constraint_id, tied / sum(tied) OVER (PARTITION BY scenario_id, draw_index) AS credit FROM k),
 n AS (SELECT scenario_id, count(DISTINCT draw_index) AS n FROM c GROUP BY ALL)
SELECT scenario_id, constraint_id, {sq("sum(credit) / any_value(n)")} AS probability FROM g JOIN n USING (scenario_id) GROUP BY ALL""")
def a3_binding_probability(t):
    out = A.binding_probability(constraints(t), ["scenario_id"], "draw_index", "constraint_id", "equivalents")
    return settled(out, ["probability"], 6)


@query(f"""SELECT l_orderkey, {sq("sum(l_quantity * 0.9)")} AS low, {sq("sum(l_quantity)")} AS base, {sq("sum(l_quantity * 1.1)")} AS high,
  {sq("min(1 - l_discount)")} AS confidence, CASE WHEN bool_and(l_returnflag IN ('A', 'N')) THEN 'reported' ELSE 'derived' END AS posture,
  count(*) AS parts FROM lineitem GROUP BY l_orderkey""")
def a4_sum_ranges(t):
    q = F.col("l_quantity")
    rows = t.lineitem.select(
        "l_orderkey", (q * 0.9).alias("low"), q.alias("base"), (q * 1.1).alias("high"),
        (1 - F.col("l_discount")).alias("confidence"), "l_returnflag",
    )
    out = A.sum_ranges(rows, ["l_orderkey"], F.col("l_returnflag").isin("A", "N"))
    return settled(out, ["low", "base", "high", "confidence"], 6)


@query(f"""SELECT p_brand, p_size, CASE WHEN min(p_type) = max(p_type) THEN {sq("avg(p_retailprice)", 4)} END AS guarded_mean
FROM part GROUP BY p_brand, p_size""")
def a6_unit_guarded_mean(t):
    out = t.part.groupBy("p_brand", "p_size").agg(A.unit_guarded_mean("p_retailprice", "p_type").alias("guarded_mean"))
    return settled(out, ["guarded_mean"])


@query(f"""WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
 r AS (SELECT l_partkey, v, v / sum(v) OVER (PARTITION BY l_partkey) AS share FROM s)
SELECT l_partkey, {sq("sum(v)", 4)} AS total, {sq("sum(share * share)")} AS hhi, {sq("max(share)")} AS largest_share FROM r GROUP BY l_partkey""")
def a8_concentration(t):
    pool = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    out = settled(A.concentration(pool, ["l_partkey"], "v"), ["total"])
    return settled(out, ["hhi", "largest_share"], 6)


@query(f"""WITH s AS (SELECT l_returnflag, l_orderkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
 m AS (SELECT *, sum(v) OVER (PARTITION BY l_returnflag, l_orderkey) - v < 30 AS missed FROM s)
SELECT l_returnflag, l_suppkey, {sq("avg(CASE WHEN missed THEN 1 ELSE 0 END)")} AS criticality_probability, count(*) AS draws
FROM m GROUP BY ALL""")
def a9_single_source_criticality(t):
    pool = t.lineitem.groupBy("l_returnflag", "l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    out = A.single_source_criticality(
        pool.withColumn("demand", F.lit(30.0)), ["l_returnflag", "l_orderkey"], ["l_returnflag"], "l_suppkey", "v", "demand"
    )
    return settled(out, ["criticality_probability"], 6)


@query(f"""SELECT l_suppkey, count(*) AS row_count, count_if(l_quantity > 40) AS large_count,
 {sq("avg(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)")} AS large_rate, count_if(l_tax = 0) AS untaxed_count,
 {sq("avg(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END)")} AS untaxed_rate FROM lineitem GROUP BY l_suppkey""")
def a10_conditional_counts(t):
    flags = {"large": F.col("l_quantity") > 40, "untaxed": F.col("l_tax") == 0}
    return settled(A.conditional_counts(t.lineitem, ["l_suppkey"], flags), ["large_rate", "untaxed_rate"], 6)


@query(f"""SELECT p_brand, {sq("sum(p_retailprice)", 2)} AS total_weight, {sq("sum(CASE WHEN p_size > 20 THEN p_retailprice ELSE 0 END)", 2)} AS covered_weight,
 {sq("sum(CASE WHEN p_size > 20 THEN p_retailprice ELSE 0 END) / sum(p_retailprice)")} AS weighted_share FROM part GROUP BY p_brand""")
def a11_weighted_share(t):
    out = settled(A.weighted_share(t.part, ["p_brand"], "p_retailprice", F.col("p_size") > 20), ["weighted_share"], 6)
    return settled(out, ["total_weight", "covered_weight"], 2)


@query(f"""SELECT p_partkey AS forecast_id, CASE WHEN p_type = 'PROMO' THEN 'at_most' ELSE 'at_least' END AS operator,
 CAST(p_size AS DOUBLE) AS threshold, count(*) AS draws,
 {sq("avg(CASE WHEN (p_type = 'PROMO' AND l_quantity <= p_size) OR (p_type <> 'PROMO' AND l_quantity >= p_size) THEN 1 ELSE 0 END)")} AS forecast_probability
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def a12_event_probability(t):
    events = t.part.select(
        F.col("p_partkey").alias("forecast_id"), F.when(F.col("p_type") == "PROMO", "at_most").otherwise("at_least").alias("operator"),
        F.col("p_size").cast("double").alias("threshold"),
    )
    draws = t.lineitem.select(F.col("l_partkey").alias("forecast_id"), "l_quantity")
    return settled(A.event_probability(draws, events, ["forecast_id"], "l_quantity"), ["forecast_probability"], 6)


@query("""SELECT s.status, count(o_orderkey) AS row_count FROM (VALUES ('O'), ('F'), ('P'), ('cancelled')) AS s(status)
LEFT JOIN orders ON o_orderstatus = s.status GROUP BY s.status""")
def a13_status_counts(t):
    return A.status_counts(t.orders, "o_orderstatus", ["O", "F", "P", "cancelled"])


@query("""SELECT l_returnflag, CASE WHEN l_returnflag = 'N' THEN 'p50|maximum' ELSE '' END AS mismatched, l_returnflag <> 'N' AS reproduced
FROM lineitem GROUP BY l_returnflag""")
def a14_reproduce_distribution(t):
    frozen = A.summarize(t.lineitem, ["l_returnflag"], "l_extendedprice")
    shift = F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)
    frozen = frozen.withColumn("p50", F.col("p50") + shift).withColumn("maximum", F.col("maximum") + shift)
    out = A.reproduce_distribution(t.lineitem, frozen, ["l_returnflag"], "l_extendedprice", 1e-12, 1e-8)
    return out.select("l_returnflag", F.concat_ws("|", "mismatched_fields").alias("mismatched"), "reproduced")


@query(f"""SELECT l_orderkey, {sq("min(1 - l_discount)")} AS minimum_confidence, count_if(l_returnflag = 'R') AS synthetic_inputs
FROM lineitem GROUP BY l_orderkey""")
def a15_a18_estimate_audit(t):
    estimates = t.lineitem.select(
        "l_orderkey", (1 - F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "synthetic").otherwise("reported").alias("posture"),
    )
    out = A.minimum_confidence(estimates, ["l_orderkey"]).join(A.synthetic_input_count(estimates, ["l_orderkey"]), "l_orderkey")
    return settled(out, ["minimum_confidence"], 6)


@query(f"""SELECT l_suppkey, {sq("avg(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END)")} AS supply_limited,
 {sq("avg(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)")} AS zero_residual FROM lineitem GROUP BY l_suppkey""")
def a17_limited_share(t):
    out = A.limited_share(t.lineitem, ["l_suppkey"], {"supply_limited": F.col("l_quantity") >= 45, "zero_residual": F.col("l_discount") == 0})
    return settled(out, ["supply_limited", "zero_residual"], 6)


def revisions(t):
    """Claim = user, revision = event, recorded at its timestamp; an error event retracts."""
    day = F.to_date("ts")
    return t.events.select(
        F.col("user_id").alias("claim_key"), F.col("event_id").alias("revision_id"), F.col("ts").alias("recorded_at"),
        "value", day.alias("valid_from"), F.when(F.col("event_type") == "view", F.date_add(day, 3)).alias("valid_to"),
        F.when(F.col("event_type") == "error", "retracted").otherwise("asserted").alias("status"),
    )


REVISIONS = """r AS (SELECT user_id AS claim_key, event_id AS revision_id, ts AS recorded_at, value, CAST(ts AS DATE) AS valid_from,
  CASE WHEN event_type = 'view' THEN CAST(ts AS DATE) + 3 END AS valid_to,
  CASE WHEN event_type = 'error' THEN 'retracted' ELSE 'asserted' END AS status FROM events)"""


@query(f"""WITH {REVISIONS} SELECT claim_key, revision_id, value FROM (SELECT *, row_number() OVER (PARTITION BY claim_key
   ORDER BY recorded_at DESC, revision_id DESC) AS k FROM r) WHERE k = 1 AND status = 'asserted'""")
def w1_latest_revision(t):
    return W.latest_revision(revisions(t), ["claim_key"]).select("claim_key", "revision_id", "value")


@query("""WITH s AS (SELECT user_id AS claim_key, event_id AS revision_id, event_type,
   lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT revision_id, CASE WHEN prev IS NULL THEN CASE WHEN event_type = 'signup' THEN 'first_revision_supersedes' ELSE '' END
   WHEN event_type IN ('error', 'signup') THEN 'wrong_predecessor' ELSE '' END AS problem FROM s""")
def w2_check_supersession(t):
    from tallyforge.operators.skew import chunked_lag

    claims = revisions(t).join(t.events.select(F.col("event_id").alias("revision_id"), "event_type"), "revision_id")
    named = chunked_lag(
        claims, ["claim_key"], ["recorded_at", "revision_id"], F.date_trunc("day", "recorded_at"), {"prev": "revision_id"}
    )
    stated = F.when(F.col("event_type") == "signup", F.lit(-1)).when(F.col("event_type") != "error", F.col("prev"))
    packs = named.withColumn("supersedes_revision_id", stated.cast("bigint"))
    out = W.check_supersession(packs, F.date_trunc("hour", "recorded_at"))
    return out.select("revision_id", F.coalesce("problem", F.lit("")).alias("problem"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS rank FROM supplier""")
def w3_rank_candidates(t):
    return W.rank_candidates(t.supplier, [], "s_acctbal", ["s_name"]).select("s_suppkey", "rank")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part""")
def w3_rank_within_group(t):
    return W.rank_candidates(t.part, ["p_brand"], "p_retailprice", ["p_partkey"]).select("p_brand", "p_partkey", "rank")


@query(f"""WITH g AS (SELECT l_suppkey, l_linenumber AS constraint_id, count(*) AS n FROM lineitem GROUP BY ALL),
 p AS (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS probability FROM g)
SELECT l_suppkey, constraint_id, {sq("probability")} AS probability FROM p
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, constraint_id) = 1""")
def w4_top_binding(t):
    counts = t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").alias("constraint_id")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("l_suppkey").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "l_suppkey").withColumn("probability", F.col("n") / F.col("total"))
    return settled(W.top_binding(shares, ["l_suppkey"]), ["probability"], 6)


def fill_inputs(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").alias("weight"), F.col("l_quantity").alias("cap"),
    )
    totals = rows.groupBy("l_orderkey").agg((F.sum("cap") * 0.6).alias("total"))
    return rows, totals


FILL = """r AS (SELECT *, l_quantity / l_extendedprice AS ratio FROM lineitem),
 t AS (SELECT l_orderkey, 0.6 * sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey),
 s AS (SELECT l_orderkey, ratio, sum(l_quantity) AS cap, sum(l_extendedprice) AS wt FROM r GROUP BY ALL),
 v AS (SELECT s.l_orderkey, ratio, (total - (sum(cap) OVER (PARTITION BY s.l_orderkey ORDER BY ratio) - cap))
        / sum(wt) OVER (PARTITION BY s.l_orderkey ORDER BY ratio DESC) AS level FROM s JOIN t USING (l_orderkey)),
 f AS (SELECT l_orderkey, max(level) FILTER (WHERE level < ratio) AS fill FROM v GROUP BY l_orderkey),
 a AS (SELECT r.*, total, least(l_quantity, coalesce(fill * l_extendedprice, l_quantity)) AS allocated
       FROM r JOIN f USING (l_orderkey) JOIN t USING (l_orderkey))"""


@query(f"WITH {FILL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sq('allocated', 5)} AS allocated FROM a")
def w5_water_fill(t):
    rows, totals = fill_inputs(t)
    out = W.water_fill(rows, totals, ["l_orderkey"], "weight", "cap")
    return settled(out, ["allocated"], 5).drop("weight", "cap")


@query(f"WITH {FILL} SELECT l_orderkey, {sq('greatest(any_value(total) - sum(allocated), 0.0)', 5)} AS unallocated FROM a GROUP BY l_orderkey")
def w5_unallocated(t):
    rows, totals = fill_inputs(t)
    filled = W.water_fill(rows, totals, ["l_orderkey"], "weight", "cap")
    return settled(W.unallocated(filled, totals, ["l_orderkey"]), ["unallocated"], 5)


@query("""SELECT l_orderkey, count(*) AS draws, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber)
   AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY l_orderkey""")
def w6_check_contiguous(t):
    draws = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("draw_index"))
    return W.check_contiguous(draws, ["l_orderkey"])


@query(f"""WITH {CONSTRAINTS} SELECT scenario_id, draw_index, constraint_id,
 {sq("min(equivalents) OVER (PARTITION BY scenario_id, draw_index ORDER BY constraint_id)")} AS stage_output FROM c""")
def w7_cumulative_stage_output(t):
    out = W.cumulative_stage_output(constraints(t), ["scenario_id", "draw_index"], "constraint_id", "equivalents")
    return settled(out, ["stage_output"], 6).drop("equivalents")


@query(f"""WITH {CONSTRAINTS}, o AS (SELECT *, min(equivalents) OVER (PARTITION BY scenario_id, draw_index ORDER BY constraint_id) AS out FROM c)
SELECT scenario_id, draw_index, constraint_id,
 {sq("greatest(coalesce(lag(out) OVER (PARTITION BY scenario_id, draw_index ORDER BY constraint_id), 100.0) - out, 0.0)")} AS held_back FROM o""")
def w8_stage_holdback(t):
    out = W.cumulative_stage_output(constraints(t), ["scenario_id", "draw_index"], "constraint_id", "equivalents")
    held = W.stage_holdback(out.withColumn("demand", F.lit(100.0)), ["scenario_id", "draw_index"], "constraint_id", "stage_output", "demand")
    return settled(held.select("scenario_id", "draw_index", "constraint_id", "held_back"), ["held_back"], 6)


@query(f"""WITH {CONSTRAINTS} SELECT scenario_id, draw_index, constraint_id, CAST(stage AS INTEGER) AS stage_rank, {sq("equivalents")} AS equivalents
FROM c, range(1, 8) AS s(stage) WHERE constraint_id <= stage""")
def j11_eligible_constraints(t):
    return settled(J.eligible_constraints(constraints(t), "constraint_id", 7), ["equivalents"], 6)


@query("""SELECT event_id, ts_text, event_type FROM (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS ts_text, ts,
  row_number() OVER (ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'purchase') WHERE k <= 100""")
def t4_oldest_pending(t):
    outbox = t.events.select(
        "event_id", F.col("ts").alias("created_at"), "event_type",
        F.when(F.col("event_type") == "purchase", "delivered").otherwise("pending").alias("status"),
    )
    out = O.oldest_pending(outbox, 100)
    return out.select("event_id", F.date_format("created_at", "yyyy-MM-dd").alias("ts_text"), "event_type")


@query("""SELECT event_id, severity, type, path, row_number() OVER (ORDER BY rank, type, path, event_id) AS position FROM (SELECT event_id,
 CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'high' WHEN 'view' THEN 'medium' ELSE 'info' END AS severity,
 CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS rank, event_type AS type, 'user.' || user_id AS path FROM events)""")
def t2_order_alerts(t):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "signup", "high").when(kind == "view", "medium").otherwise("info")
    alerts = t.events.select("event_id", severity.alias("severity"), kind.alias("type"), F.concat(F.lit("user."), "user_id").alias("path"), F.col("event_id").alias("id"))
    return O.with_position(O.order_alerts(alerts)).drop("id")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date, o_orderstatus AS form,
 row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderdate, o_custkey, o_orderkey) AS position FROM orders""")
def t5_order_filings(t):
    f = t.orders.select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("filing_date"), F.col("o_orderstatus").alias("form"),
        F.col("o_orderdate").alias("acceptance_datetime"), F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("accession_number"),
    )
    return O.with_position(O.order_filings(f)).select("o_orderkey", "filing_date", "form", "position")


CUTOFFS = [
    ("early", datetime(2024, 1, 10, 12), date(2024, 1, 10)),
    ("late", datetime(2024, 1, 25), date(2024, 1, 20)),
]


def as_of(t):
    seen = J.eligible_revisions(revisions(t), CUTOFFS)
    return W.latest_revision(seen.drop("known_at", "valid_at"), ["cutoff", "claim_key"])


AS_OF = f"""{REVISIONS}, k AS (SELECT * FROM (VALUES ('early', TIMESTAMP '2024-01-10 12:00:00', DATE '2024-01-10'),
   ('late', TIMESTAMP '2024-01-25', DATE '2024-01-20')) AS v(cutoff, known_at, valid_at)),
 e AS (SELECT cutoff, r.*, row_number() OVER (PARTITION BY cutoff, claim_key ORDER BY recorded_at DESC, revision_id DESC) AS n
   FROM r JOIN k ON recorded_at <= known_at AND valid_from <= valid_at AND (valid_to IS NULL OR valid_at < valid_to)),
 snap AS (SELECT cutoff, claim_key, revision_id, value FROM e WHERE n = 1 AND status = 'asserted')"""


@query(f"WITH {AS_OF} SELECT * FROM snap")
def j9_as_of_snapshot(t):
    return as_of(t).select("cutoff", "claim_key", "revision_id", "value")


DIFF = f"""{AS_OF}, d AS (SELECT coalesce(a.claim_key, b.claim_key) AS claim_key, a.revision_id AS previous_revision_id, b.revision_id AS current_revision_id,
  CASE WHEN a.claim_key IS NULL THEN 'claim_added' WHEN b.claim_key IS NULL THEN 'claim_removed'
       WHEN a.revision_id <> b.revision_id THEN 'claim_revised' END AS type,
  CASE WHEN a.claim_key IS NULL THEN 'info' WHEN b.claim_key IS NULL THEN 'high' ELSE 'medium' END AS severity
  FROM (SELECT * FROM snap WHERE cutoff = 'early') a FULL JOIN (SELECT * FROM snap WHERE cutoff = 'late') b USING (claim_key))"""


@query(f"WITH {DIFF} SELECT * FROM d WHERE type IS NOT NULL")
def j3_diff_snapshots(t):
    both = as_of(t)
    return J.diff_snapshots(both.where("cutoff = 'early'"), both.where("cutoff = 'late'"), "claim_key", "revision_id")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, parameter, {sq("low")} AS low, {sq("base")} AS base, {sq("high")} AS high, unit, posture, {sq("confidence")} AS confidence
FROM (SELECT *, 'capacity' AS parameter, l_quantity * 0.8 AS low, l_quantity AS base, l_quantity * 1.2 AS high, 'unit' AS unit, 'reported' AS posture, 0.9 AS confidence FROM lineitem
 UNION ALL SELECT *, 'effective_yield', 1 - l_discount, 1 - l_discount, 1.0, 'ratio', 'synthetic', 0.4 FROM lineitem)""")
def p2_estimates_long(t):
    def estimate(low, base, high, unit, posture, confidence):
        return F.struct(low.alias("low"), base.alias("base"), high.alias("high"), F.lit(unit).alias("unit"), F.lit(posture).alias("posture"), F.lit(confidence).alias("confidence"))

    q, y = F.col("l_quantity"), 1 - F.col("l_discount")
    wide = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        estimate(q * 0.8, q, q * 1.2, "unit", "reported", 0.9).alias("capacity"),
        estimate(y, y, F.lit(1.0), "ratio", "synthetic", 0.4).alias("effective_yield"),
    )
    out = P.estimates_long(wide, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["capacity", "effective_yield"])
    return settled(out, ["low", "base", "high", "confidence"], 6)


@query(f"SELECT l_returnflag, {six_sql('l_extendedprice').replace(' AS ', ' AS price_')} FROM lineitem GROUP BY l_returnflag".replace("AS price_DOUBLE", "AS DOUBLE"))
def p5_distribution_columns(t):
    nested = P.as_distribution(A.summarize(t.lineitem, ["l_returnflag"], "l_extendedprice"))
    out = P.distribution_columns(nested, "price")
    return settled(out, [f"price_{n}" for n in SIX])
