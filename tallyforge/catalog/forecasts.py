"""Forecast jobs over the driver tables: forecasts = early quantities of a part, outcomes = later ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.dates import quarter_end, quarter_of
from tallyforge.operators.aggregates import summarize
from tallyforge.operators.joins import pair_metrics
from tallyforge.plans import forecasts as P

from . import query, sq
from .aggregates import settled

SPLIT = "1998-01-01"


def forecast_inputs(t):
    early = t.lineitem.where(F.col("l_shipdate") < SPLIT).select(F.col("l_partkey").alias("forecast_id"), "l_quantity")
    frozen = summarize(early, ["forecast_id"], "l_quantity").select("forecast_id", "p10", "p50", "p90")
    facts = t.part.select(
        F.col("p_partkey").alias("forecast_id"), F.col("p_type").alias("metric_class"), F.col("p_brand").alias("source_family"),
        F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise("unit").alias("unit"),
        F.when(F.col("p_size") > 20, "at_least").when(F.col("p_size") > 5, "at_most").alias("operator"), F.lit(25.0).alias("threshold"),
    )
    forecasts = frozen.join(facts, "forecast_id")
    outcomes = t.lineitem.where(F.col("l_shipdate") >= SPLIT).groupBy(F.col("l_partkey").alias("forecast_id")).agg(F.avg("l_quantity").alias("actual_value"))
    return forecasts, outcomes


def scores_sql(p10: str, p50: str, p90: str) -> str:
    return f"""f AS (SELECT l_partkey AS forecast_id, {p10} AS p10, {p50} AS p50, {p90} AS p90
   FROM lineitem WHERE l_shipdate < DATE '{SPLIT}' GROUP BY ALL),
 o AS (SELECT l_partkey AS forecast_id, avg(l_quantity) AS a FROM lineitem WHERE l_shipdate >= DATE '{SPLIT}' GROUP BY ALL),
 j AS (SELECT f.*, a, p_type AS metric_class, p_brand AS source_family, CASE WHEN p_type = 'PROMO' THEN p_name ELSE 'unit' END AS unit,
   CASE WHEN p_size > 20 THEN 'at_least' WHEN p_size > 5 THEN 'at_most' END AS op, 25.0 AS th FROM f JOIN o USING (forecast_id) JOIN part ON p_partkey = forecast_id),
 k AS (SELECT *, p50 - a AS err, greatest((p90 - p10) / 2, abs(p50) * 0.01, 1e-12) AS hw,
   (CASE WHEN a >= p10 THEN 0.1 * (a - p10) ELSE 0.9 * (p10 - a) END + 0.5 * abs(a - p50) + CASE WHEN a >= p90 THEN 0.9 * (a - p90) ELSE 0.1 * (p90 - a) END) / 3 AS pin,
   CASE WHEN th <= p10 THEN 0.0 WHEN th >= p90 THEN 1.0 WHEN th <= p50 THEN CASE WHEN p50 = p10 THEN 0.0 ELSE (th - p10) * (th - p10) / ((p90 - p10) * (p50 - p10)) END
     ELSE CASE WHEN p50 = p90 THEN 1.0 ELSE 1 - (p90 - th) * (p90 - th) / ((p90 - p10) * (p90 - p50)) END END AS cdf FROM j),
 s AS (SELECT *, a BETWEEN p10 AND p90 AS inside, err / a AS ratio, a / p50 AS ap, abs(err) / hw AS nae, pin / greatest(abs(a), 1e-12) AS npin,
   CASE WHEN op IS NULL THEN NULL WHEN p10 = p90 THEN CASE WHEN (op = 'at_least' AND p50 >= th) OR (op = 'at_most' AND p50 <= th) THEN 1.0 ELSE 0.0 END
     WHEN op = 'at_least' THEN 1 - cdf ELSE cdf END AS prob,
   CASE op WHEN 'at_least' THEN a >= th WHEN 'at_most' THEN a <= th END AS realized FROM k),
 z AS (SELECT *, (prob - CASE WHEN realized THEN 1 ELSE 0 END) * (prob - CASE WHEN realized THEN 1 ELSE 0 END) AS brier FROM s)"""


QUANTILES = [f"quantile_cont(l_quantity, {q})" for q in (0.1, 0.5, 0.9)]
SCORES = scores_sql(*QUANTILES)
FROZEN_SCORES = scores_sql(*[sq(q) for q in QUANTILES])  # an outcome on an interval's end is inside, whatever the last bit of the interpolation

SCORE_COLUMNS = {
    "signed_error": "err", "signed_error_ratio": "ratio", "actual_to_p50_ratio": "ap", "interval_miss": "greatest(p10 - a, a - p90, 0.0)",
    "normalized_absolute_error": "nae", "mean_pinball_loss": "pin", "normalized_mean_pinball_loss": "npin", "event_probability": "prob", "brier_score": "brier",
}


@query(f"WITH {FROZEN_SCORES} SELECT forecast_id, inside AS inside_p10_p90, realized AS event_realized, {', '.join(f'{sq(v)} AS {k}' for k, v in SCORE_COLUMNS.items())} FROM z")
def co14_score_forecasts(t):
    """Forecasts are frozen at six places, so that an outcome equal to p10 or p90 meets it."""
    forecasts, outcomes = forecast_inputs(t)
    out = P.score_forecasts(settled(forecasts, ["p10", "p50", "p90"], 6), outcomes)
    return settled(out.select("forecast_id", "inside_p10_p90", "event_realized", *SCORE_COLUMNS), list(SCORE_COLUMNS), 6)


@query(f"""WITH {SCORES}, g AS (SELECT CASE WHEN grouping(metric_class) = 0 THEN 'metric_class' WHEN grouping(source_family) = 0 THEN 'source_family' ELSE 'overall' END AS "grouping",
   CASE WHEN grouping(metric_class) = 0 THEN metric_class WHEN grouping(source_family) = 0 THEN source_family ELSE 'all' END AS "group",
   count(*) AS forecasts, count(ap) AS ratios, avg(CASE WHEN inside THEN 1 ELSE 0 END) AS coverage, CASE WHEN count(DISTINCT unit) = 1 THEN avg(err) END AS mse,
   CASE WHEN count(DISTINCT unit) = 1 THEN avg(abs(err)) END AS mae, avg(ratio) AS msr, avg(abs(ratio)) AS mape, avg(npin) AS mnp, avg(brier) AS mb, count(brier) AS nb,
   quantile_cont(ap, 0.5) AS med, quantile_cont(nae, 0.8) AS wid FROM z GROUP BY GROUPING SETS ((), (metric_class), (source_family)))
SELECT "grouping", "group", forecasts, {sq("coverage")} AS coverage_rate, {sq("mse")} AS mean_signed_error, {sq("mae")} AS mean_absolute_error, {sq("msr")} AS mean_signed_error_ratio,
 {sq("mape")} AS mean_absolute_percentage_error, {sq("mnp")} AS mean_normalized_pinball_loss, {sq("mb")} AS mean_brier_score, nb AS brier_event_count,
 CASE WHEN "grouping" <> 'metric_class' THEN 'diagnostic_only' WHEN forecasts < 320 THEN 'insufficient_history' WHEN ratios <> forecasts THEN 'not_estimable_zero_p50' ELSE 'holdout_validation_required' END AS proposal_status,
 CASE WHEN "grouping" = 'metric_class' THEN greatest(320 - forecasts, 0) END AS additional_outcomes_needed,
 CASE WHEN "grouping" = 'metric_class' AND forecasts >= 320 AND ratios = forecasts THEN {sq("med")} END AS p50_multiplier,
 CASE WHEN "grouping" = 'metric_class' AND forecasts >= 320 AND ratios = forecasts THEN {sq("greatest(1.0, wid)")} END AS half_width_multiplier FROM g""")
def co14_scorecard(t):
    out = P.scorecard(P.score_forecasts(*forecast_inputs(t)), 320)
    rounded = [c for c in out.columns if c.startswith("mean_") or c.endswith("multiplier") or c == "coverage_rate"]
    return settled(out, rounded, 6)


def guidance_pairs(t):
    p = F.col("p_retailprice")
    spread = F.when(F.col("p_type") == "PROMO", 0.0).otherwise(0.05)
    guidance = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("metric_class"), (p * (1 - spread)).alias("low"), p.alias("midpoint"),
        (p * (1 + spread)).alias("high"), F.lit("usd").alias("unit"),
    )
    actual = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value")).withColumn("unit", F.lit("usd"))
    return pair_metrics(guidance, actual, "id", ["unit"], "value")


GUIDANCE = """v AS (SELECT l_partkey AS id, avg(l_extendedprice / l_quantity) AS a FROM lineitem GROUP BY ALL),
 g AS (SELECT id, a, p_type AS metric_class, p_retailprice AS m, p_retailprice * (1 - CASE WHEN p_type = 'PROMO' THEN 0.0 ELSE 0.05 END) AS lo,
   p_retailprice * (1 + CASE WHEN p_type = 'PROMO' THEN 0.0 ELSE 0.05 END) AS hi FROM part JOIN v ON id = p_partkey),
 s AS (SELECT *, CASE WHEN a BETWEEN lo AND hi THEN 'inside_range' WHEN a > hi THEN 'above_range' ELSE 'below_range' END AS dir, (m - a) / a AS ratio,
   abs(m - a) / greatest((hi - lo) / 2, abs(m) * 0.01, 1e-12) AS nae FROM g)"""


@query(f"""WITH {GUIDANCE} SELECT id, dir AS surprise_direction, {sq("m - a", 4)} AS signed_error, {sq("ratio")} AS signed_error_ratio, {sq("a / m")} AS actual_to_midpoint_ratio,
 {sq("greatest(lo - a, a - hi, 0.0)", 4)} AS interval_miss, {sq("nae", 4)} AS normalized_absolute_error FROM s""")
def co15_score_guidance(t):
    out = P.score_guidance(guidance_pairs(t)).select(
        "id", "surprise_direction", "signed_error", "signed_error_ratio", "actual_to_midpoint_ratio", "interval_miss", "normalized_absolute_error"
    )
    return settled(settled(out, ["signed_error", "interval_miss", "normalized_absolute_error"]), ["signed_error_ratio", "actual_to_midpoint_ratio"], 6)


@query(f"""WITH {GUIDANCE} SELECT metric_class, count(*) AS row_count, count_if(dir = 'inside_range') AS inside_range_count, {sq("avg(CASE WHEN dir = 'inside_range' THEN 1 ELSE 0 END)")} AS inside_range_rate,
 count_if(dir = 'above_range') AS above_range_count, {sq("avg(CASE WHEN dir = 'above_range' THEN 1 ELSE 0 END)")} AS above_range_rate,
 count_if(dir = 'below_range') AS below_range_count, {sq("avg(CASE WHEN dir = 'below_range' THEN 1 ELSE 0 END)")} AS below_range_rate,
 {sq("avg(abs(ratio))")} AS mean_absolute_percentage_error, {sq("avg(nae)", 4)} AS mean_normalized_absolute_error FROM s GROUP BY metric_class""")
def co15_guidance_summary(t):
    out = P.guidance_summary(P.score_guidance(guidance_pairs(t)), ["metric_class"])
    rates = [c for c in out.columns if c.endswith("_rate")] + ["mean_absolute_percentage_error"]
    return settled(settled(out, rates, 6), ["mean_normalized_absolute_error"], 4)


def contracts(t):
    """One forecast per order: cutoff = its quarter end, draws = its lines."""
    cutoff = quarter_end(quarter_of("o_orderdate"))
    return t.orders.select(
        F.col("o_orderkey").alias("forecast_id"), F.when(F.col("o_orderstatus") == "F", "at_most").otherwise("at_least").alias("operator"),
        F.lit(20.0).alias("threshold"), cutoff.alias("cutoff"), F.date_add(cutoff, 20).alias("earliest"), F.date_add(cutoff, 80).alias("expected"),
        (F.col("o_orderpriority") == "1-URGENT").alias("synthetic"), F.lit("unit").alias("unit"),
    )


REGISTER = """d AS (SELECT l_orderkey AS forecast_id, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90,
   avg(CASE WHEN o_orderstatus = 'F' AND l_quantity <= 20 OR o_orderstatus <> 'F' AND l_quantity >= 20 THEN 1 ELSE 0 END) AS prob FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
 c AS (SELECT o_orderkey AS forecast_id, o_orderstatus, o_orderpriority, o_totalprice, date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS cutoff FROM orders),
 r AS (SELECT *, CASE WHEN DATE '1999-02-01' <= cutoff THEN 'pending_period_end' WHEN DATE '1999-02-01' < cutoff + INTERVAL 20 DAY THEN 'pending_observation_window'
    WHEN DATE '1999-02-01' <= cutoff + INTERVAL 80 DAY THEN 'awaiting_outcome' ELSE 'outcome_overdue' END AS maturity FROM c JOIN d USING (forecast_id))"""


@query(f"""WITH {REGISTER} SELECT forecast_id, {sq("p10")} AS p10, {sq("p50")} AS p50, {sq("p90")} AS p90, o_orderstatus <> 'P' AS reproduced, {sq("prob")} AS forecast_probability, maturity,
 DATE '1999-02-01' >= cutoff + INTERVAL 20 DAY AS calendar_eligible, concat_ws('|', 'realized_outcome_not_attached', CASE maturity WHEN 'pending_period_end' THEN 'forecast_period_not_ended'
  WHEN 'pending_observation_window' THEN 'outcome_observation_window_not_open' WHEN 'outcome_overdue' THEN 'expected_evidence_date_passed' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'source_scenario_is_synthetic' END) AS blockers FROM r""")
def co16_register_forecasts(t):
    return registered(t).select("forecast_id", "p10", "p50", "p90", "reproduced", "forecast_probability", "maturity", "calendar_eligible", F.concat_ws("|", "blockers").alias("blockers"))


def registered(t, as_of="1999-02-01"):
    draws = t.lineitem.select(F.col("l_orderkey").alias("forecast_id"), F.col("l_quantity").alias("value"))
    frozen = summarize(draws, ["forecast_id"], "value")
    off = t.orders.select(F.col("o_orderkey").alias("forecast_id"), (F.col("o_orderstatus") == "P").alias("_off"))
    frozen = frozen.join(off, "forecast_id").withColumn("mean", F.when(F.col("_off"), F.col("mean") + 1).otherwise(F.col("mean"))).drop("_off")
    return settled(P.register_forecasts(draws, frozen, contracts(t), as_of)[0], ["p10", "p50", "p90", "forecast_probability"], 6)


def reviewed(t):
    forecasts = registered(t).drop("blockers", "maturity")
    status = (
        F.when(F.col("o_orderpriority") == "2-HIGH", "observed").when(F.col("o_orderpriority") == "3-MEDIUM", "unobservable")
        .when(F.col("o_orderpriority") == "5-LOW", "not_comparable").otherwise("pending")
    )
    dispositions = t.orders.where("o_totalprice > 20000").select(
        F.col("o_orderkey").alias("forecast_id"), status.alias("status"), F.when(F.col("o_orderstatus") == "O", "crate").otherwise("unit").alias("unit"),
        (F.col("o_totalprice") / 10000).alias("actual_value"), F.lit("reported").alias("posture"), F.lit("1999-01-31").cast("date").alias("observed_at"),
    )
    return P.review_outcomes(forecasts, dispositions, "1999-02-01")


REVIEW = f"""{REGISTER}, v AS (SELECT r.*, o_totalprice > 20000 AS has, CASE o_orderpriority WHEN '2-HIGH' THEN 'observed' WHEN '3-MEDIUM' THEN 'unobservable' WHEN '5-LOW' THEN 'not_comparable' ELSE 'pending' END AS st FROM r),
 w AS (SELECT *, CASE WHEN NOT has THEN 'no_disposition' WHEN st = 'pending' AND DATE '1999-02-01' > cutoff + INTERVAL 80 DAY THEN 'overdue_without_disposition'
   WHEN st = 'unobservable' AND DATE '1999-02-01' <= cutoff + INTERVAL 80 DAY THEN 'unobservable_too_early' WHEN st IN ('not_comparable', 'observed') AND DATE '1999-02-01' < cutoff + INTERVAL 20 DAY THEN 'window_not_open'
   WHEN st = 'observed' AND o_orderstatus = 'O' THEN 'unit_mismatch' WHEN st = 'observed' AND DATE '1999-01-31' < cutoff + INTERVAL 20 DAY THEN 'observed_outside_window' END AS code,
   CASE WHEN st = 'observed' THEN o_totalprice / 10000 END AS a FROM v)"""


@query(f"""WITH {REVIEW} SELECT forecast_id, st AS disposition, CASE st WHEN 'unobservable' THEN 'closed_unobservable' WHEN 'not_comparable' THEN 'closed_not_comparable' WHEN 'observed' THEN 'observed_and_scored'
  ELSE CASE WHEN DATE '1999-02-01' <= cutoff THEN 'pending_period_end' ELSE 'awaiting_outcome' END END AS calendar_status, {sq("a", 4)} AS actual_value, a BETWEEN floor(p10 * 1e6 + 0.3217) / 1e6 AND floor(p90 * 1e6 + 0.3217) / 1e6 AS inside_p10_p90,
  {sq("p50 - a", 4)} AS signed_error FROM w WHERE code IS NULL""")
def co17_review_outcomes(t):
    rows, _ = reviewed(t)
    return settled(rows.select("forecast_id", "disposition", "calendar_status", "actual_value", "inside_p10_p90", "signed_error"), ["actual_value", "signed_error"], 4)


@query(f"WITH {REVIEW} SELECT forecast_id, code FROM w WHERE code IS NOT NULL UNION ALL SELECT o_orderkey, 'unknown_forecast' FROM orders WHERE o_totalprice > 20000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def co17_review_violations(t):
    return reviewed(t)[1]


@query("""WITH d AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '2-HIGH' THEN 'observed' WHEN '3-MEDIUM' THEN 'unobservable' WHEN '5-LOW' THEN 'not_comparable' ELSE 'pending' END AS st, o_orderstatus AS s,
   o_custkey AS c, CAST(o_orderdate AS DATE) AS day FROM orders),
 e AS (SELECT d.*, x.c_nationkey AS nation, CAST('1996-01-01' AS DATE) + x.c_nationkey * 30 AS published, y.c_custkey IS NULL AS lost FROM d LEFT JOIN customer x ON x.c_custkey = c AND x.c_acctbal > 0 LEFT JOIN customer y ON y.c_custkey = c AND y.c_acctbal > 0),
 k AS (SELECT id, 'reason_not_supported' AS code FROM e WHERE st = 'unobservable' AND s = 'P'
  UNION ALL SELECT id, 'no_evidence' FROM e WHERE st IN ('not_comparable', 'observed') AND s = 'P'
  UNION ALL SELECT id, 'evidence_repeated' FROM e WHERE st IN ('not_comparable', 'observed') AND s = 'O'
  UNION ALL SELECT id, 'evidence_missing' FROM e WHERE st IN ('not_comparable', 'observed') AND s <> 'P' AND lost
  UNION ALL SELECT id, 'mismatch_dimensions_invalid' FROM e WHERE st = 'not_comparable' AND s = 'F'
  UNION ALL SELECT id, 'mismatch_dimensions_repeated' FROM e WHERE st = 'not_comparable' AND s = 'O'
  UNION ALL SELECT id, 'family_mismatch' FROM e WHERE st = 'observed' AND s <> 'P' AND NOT lost AND nation > 12
  UNION ALL SELECT id, 'observed_before_publication' FROM e WHERE st = 'observed' AND s <> 'P' AND NOT lost AND published > day
  UNION ALL SELECT id, 'reviewed_before_retrieval' FROM e WHERE st IN ('not_comparable', 'observed') AND s <> 'P' AND NOT lost AND published + 10 > day + 5)
SELECT id AS forecast_id, code FROM k""")
def co17_review_evidence(t):
    """Orders as dispositions, customers as evidence: repeated, absent, foreign and late evidence, wrong reasons and dimensions."""
    kind, own = F.col("o_orderstatus"), F.concat(F.lit("e"), F.col("o_custkey").cast("string"))
    status = (
        F.when(F.col("o_orderpriority") == "2-HIGH", "observed").when(F.col("o_orderpriority") == "3-MEDIUM", "unobservable")
        .when(F.col("o_orderpriority") == "5-LOW", "not_comparable").otherwise("pending")
    )
    day = F.to_date("o_orderdate")
    ids = F.when(kind == "F", F.array(own)).when(kind == "O", F.array(own, own)).otherwise(F.array().cast("array<string>"))
    dimensions = F.when(kind == "F", F.array(F.lit("colour"))).when(kind == "O", F.array(F.lit("unit"), F.lit("unit"))).otherwise(F.array(F.lit("entity"), F.lit("unit")))
    dispositions = t.orders.select(
        F.col("o_orderkey").alias("forecast_id"), status.alias("status"), F.when(kind == "P", "other").otherwise("no_public_disclosure").alias("reason_code"), ids.alias("evidence_ids"),
        dimensions.alias("mismatch_dimensions"), F.lit("low").alias("source_family"), day.alias("observed_at"), F.date_add(day, 5).alias("reviewed_at"),
    )
    published = F.date_add(F.lit("1996-01-01").cast("date"), F.col("c_nationkey") * 30)
    evidence = t.customer.where("c_acctbal > 0").select(
        F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("evidence_id"), F.when(F.col("c_nationkey") > 12, "high").otherwise("low").alias("source_family"),
        published.alias("published_at"), F.date_add(published, 10).alias("retrieved_at"),
    )
    return P.review_evidence(dispositions, evidence)


@query(f"""WITH {REVIEW} SELECT count_if(st = 'pending') AS pending, count_if(st = 'unobservable') AS unobservable, count_if(st = 'not_comparable') AS not_comparable, count_if(st = 'observed') AS observed,
 {sq("avg(CASE WHEN a BETWEEN floor(p10 * 1e6 + 0.3217) / 1e6 AND floor(p90 * 1e6 + 0.3217) / 1e6 THEN 1.0 WHEN a IS NOT NULL THEN 0.0 END)")} AS interval_coverage_rate FROM w WHERE code IS NULL""")
def co17_review_summary(t):
    return settled(P.review_summary(reviewed(t)[0]), ["interval_coverage_rate"], 6)
