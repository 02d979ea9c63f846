"""Known values, brute-force comparisons and invariants of single operators."""

from __future__ import annotations

import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import maths as M
from tallyforge.functions import text as X
from tallyforge.operators import aggregates as A
from tallyforge.operators import joins as J
from tallyforge.operators import projections as P
from tallyforge.operators import windows as W
from tallyforge.operators.skew import chunked_lag, chunked_rank, exact_quantiles, own_chunks
from tallyforge.plans import capacity as C
from tallyforge.plans import conversion as V
from tallyforge.plans import earnings as E
from tallyforge.plans import filings as D
from tallyforge.plans import forecasts as R


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else row


def quantile(values, p):
    ordered = sorted(values)
    at = p * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] * (1 - at + low) + ordered[high] * (at - low)


# --- stage chain -----------------------------------------------------------------------------------


def test_stage_minima_follow_the_chain(spark):
    rows = [("s", d, f"c{i}", i, float(v)) for d in range(3) for i, v in enumerate((100, 80, 70, 60, 50, 40))]
    df = spark.createDataFrame(rows, "scenario_id string, draw_index int, constraint_id string, stage_rank int, equivalents double")
    out = C.reconcile_capacity(df, ["scenario_id"], 5)
    medians = {r.stage_rank: r.p50 for r in out["stage_summary"].collect()}
    assert medians == {0: 100, 1: 80, 2: 70, 3: 60, 4: 50, 5: 40}
    shares = {}
    for r in out["bottlenecks"].collect():
        shares[r.stage_rank] = shares.get(r.stage_rank, 0) + r.probability
    assert all(abs(v - 1) < 1e-9 for v in shares.values())


def test_tied_constraints_share_the_credit(spark):
    rows = [(0, "a", 10.0), (0, "b", 10.0), (0, "c", 12.0), (1, "a", 5.0), (1, "b", 9.0), (1, "c", 9.0)]
    df = spark.createDataFrame(rows, "draw int, id string, v double").withColumn("s", F.lit("x"))
    got = {r.id: r.probability for r in A.binding_probability(df, ["s"], "draw", "id", "v").collect()}
    assert got == pytest.approx({"a": 0.75, "b": 0.25, "c": 0.0})


# --- allocation --------------------------------------------------------------------------------------


def saturation_loop(total, weights, caps):
    """Offer shares of what is left; whoever reaches the cap keeps it and leaves."""
    given = [0.0] * len(weights)
    open_ = [i for i in range(len(weights)) if weights[i] > 0 and caps[i] > 0]
    left = max(total, 0.0)
    while open_ and left > 1e-12:
        whole = sum(weights[i] for i in open_)
        offers = {i: left * weights[i] / whole for i in open_}
        full = [i for i in open_ if offers[i] >= caps[i] - 1e-12]
        if not full:
            for i in open_:
                given[i] = offers[i]
            break
        for i in full:
            given[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    return given


@pytest.mark.parametrize("bounded", [False, True])
def test_water_fill_matches_a_saturation_loop(spark, bounded):
    rng = random.Random(3)
    rows, totals, want = [], [], {}
    for g in range(60):
        n = rng.randint(1, 9)
        weights = [rng.choice([0.0, 1.0, 1.0, rng.random() * 5]) for _ in range(n)]
        caps = [rng.choice([0.0, 2.0, rng.random() * 20]) for _ in range(n)]
        total = rng.choice([0.0, rng.random() * 60, 500.0])
        totals.append((g, total))
        for i, value in enumerate(saturation_loop(total, weights, caps)):
            rows.append((g, i, weights[i], caps[i]))
            want[g, i] = value
    df = spark.createDataFrame(rows, "g int, i int, weight double, cap double")
    filled = W.water_fill(df, spark.createDataFrame(totals, "g int, total double"), ["g"], "weight", "cap", bounded)
    got = {(r.g, r.i): r.allocated for r in filled.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_customer_split_with_caps(spark):
    rows = spark.createDataFrame([("g", "a", 0.75, 30.0), ("g", "b", 0.25, 100.0)], "g string, id string, weight double, cap double")
    totals = spark.createDataFrame([("g", 60.0)], "g string, total double")
    filled = W.water_fill(rows, totals, ["g"], "weight", "cap")
    assert {r.id: r.allocated for r in filled.collect()} == pytest.approx({"a": 30.0, "b": 30.0})
    assert W.unallocated(filled, totals, ["g"]).first().unallocated == pytest.approx(0.0)


def portfolio(spark):
    keys = ["scenario_id", "draw_index"]
    platforms = spark.createDataFrame([("p", 0, "a", 100.0, 1.0), ("p", 0, "b", 100.0, 1.0)], "scenario_id string, draw_index int, platform_id string, demand double, weight double")
    pools = [("wafers", 0, 100.0), ("assembly_a", 1, 20.0), ("assembly_b", 1, 100.0), ("racks", 2, 60.0), ("ship", 3, 50.0), ("install", 4, 45.0), ("power", 5, 30.0)]
    needs = [("a", "wafers", 1.0), ("b", "wafers", 1.0), ("a", "assembly_a", 1.0), ("b", "assembly_b", 1.0)]
    needs += [(p, pool, 1.0) for pool in ("racks", "ship", "install") for p in "ab"] + [("a", "power", 2.0), ("b", "power", 1.0)]
    pools_df = spark.createDataFrame([("p", 0, s, n, c) for n, s, c in pools], "scenario_id string, draw_index int, stage_rank int, pool_id string, capacity double")
    needs_df = spark.createDataFrame([("p", 0, *n) for n in needs], "scenario_id string, draw_index int, platform_id string, pool_id string, units double")
    return keys, platforms, pools_df, needs_df


def test_shared_pools_are_filled_stage_by_stage(spark):
    keys, platforms, pools, needs = portfolio(spark)
    filled = C.chain_fill(C.fill_groups(platforms, pools, needs, keys), keys, list(range(6)))
    out = {(r.platform_id, r.stage_rank): r for r in filled.collect()}
    assert [out["a", s].output for s in range(6)] == pytest.approx([50, 20, 20, 20, 20, 10])
    assert [out["b", s].output for s in range(6)] == pytest.approx([50, 50, 40, 30, 25, 10])
    assert out["a", 1].held_back == pytest.approx(30)
    assert out["b", 2].held_back == pytest.approx(10)
    assert out["b", 3].held_back == pytest.approx(10)
    use = C.pool_use(filled, pools, needs, keys).collect()
    assert all(r.consumption <= r.capacity + 1e-9 for r in use)
    shares = C.binding_pools(filled, keys, ["scenario_id"]).groupBy("stage_rank", "platform_id").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-9 for r in shares)


def test_random_pools_are_never_overused_and_every_stop_has_a_cause(spark):
    rng = random.Random(11)
    platforms, pools, needs = [], [], []
    for g in range(80):
        n, m = rng.randint(1, 5), rng.randint(1, 4)
        platforms += [(g, f"p{i}", rng.random() * 50, rng.random() + 0.1) for i in range(n)]
        pools += [(g, 0, f"r{j}", rng.random() * 60) for j in range(m)]
        needs += [(g, f"p{i}", f"r{j}", rng.choice([0.0, 1.0, rng.random() * 3])) for i in range(n) for j in range(m)]
    pf = spark.createDataFrame(platforms, "g int, platform_id string, demand double, weight double")
    pl = spark.createDataFrame(pools, "g int, stage_rank int, pool_id string, capacity double")
    nd = spark.createDataFrame(needs, "g int, platform_id string, pool_id string, units double")
    filled = C.chain_fill(C.fill_groups(pf, pl, nd, ["g"]), ["g"], [0])
    for r in filled.collect():
        assert r.output >= r.demand - 1e-8 or r.blockers
    assert all(r.consumption <= r.capacity + 1e-7 for r in C.pool_use(filled, pl, nd, ["g"]).collect())


# --- quantiles and order -----------------------------------------------------------------------------


def test_exact_quantiles_of_a_hot_and_a_small_group(spark):
    rng = random.Random(5)
    hot = [("hot", rng.choice([rng.gauss(0, 1), 7.0, rng.random() * 1e9])) for _ in range(40_000)]
    small = [("small", float(v)) for v in (3, 1, 2, 2)] + [("single", -4.5)]
    rows = hot + small
    out = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", (0.1, 0.5, 0.9)).collect()}
    for key in ("hot", "small", "single"):
        values = [v for k, v in rows if k == key]
        for name, p in (("_p0", 0.1), ("_p1", 0.5), ("_p2", 0.9)):
            assert out[key][name] == pytest.approx(quantile(values, p), rel=1e-12)
        assert out[key].n == len(values)


def test_chunked_helpers_equal_plain_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randint(0, 400), i, rng.random() * 100) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double")
    lagged = {r.i: r.p for r in chunked_lag(df, ["k"], ["t", "i"], F.floor(F.col("t") / 37), {"p": "i"}).collect()}
    ranks = {r.i: r.rank for r in chunked_rank(df, ["k"], "v", ["i"]).collect()}
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        previous = None
        for r in sorted(mine, key=lambda r: (r[1], r[2])):
            assert lagged[r[2]] == previous
            previous = r[2]
        for position, r in enumerate(sorted(mine, key=lambda r: (-r[3], r[2])), 1):
            assert ranks[r[2]] == position


@pytest.mark.parametrize("scale", [1.0, 1e-9, 0.0, 1e200])
def test_chunks_are_even_whatever_the_values(spark, scale):
    """Tiny, equal and huge scores: equal ones are cut by the tie column; the rank is that of one plain window."""
    draw = random.Random(4)
    rows = [(draw.choice(["hot", "hot", "hot", None]), (1 + draw.random() * 1e-6) * scale, f"item-{i:06d}") for i in range(6000)] + [("small", 1.0, "x")]
    df = spark.createDataFrame(rows, "k string, v double, name string").withColumn("_o", F.struct(-F.col("v"), "name"))
    sizes = {(r.k, r._chunk): r["count"] for r in own_chunks(df, ["k"], "_o", 200).groupBy("k", "_chunk").count().collect()}
    assert max(sizes.values()) < 800 and len([1 for k, _ in sizes if k == "hot"]) > 10 and ("small", 0) in sizes
    got = {(r.k, r.name): r.rank for r in chunked_rank(df.drop("_o"), ["k"], "v", ["name"], chunk_rows=200).collect()}
    for key in ("hot", None, "small"):
        mine = sorted((-v, n) for k, v, n in rows if k == key)
        assert [got[key, n] for _, n in mine] == list(range(1, len(mine) + 1))


def test_rank_puts_nan_first_and_nulls_last(spark):
    rows = [(None, "a"), (float("nan"), "b"), (2.0, "c"), (float("inf"), "d"), (-0.0, "f"), (0.0, "e"), (None, "g")]
    df = spark.createDataFrame(rows, "v double, name string")
    for size in (1, 1000):
        assert [r.name for r in chunked_rank(df, [], "v", ["name"], chunk_rows=size).orderBy("rank").collect()] == list("bdcefag")


def test_quantiles_of_one_group_of_all_rows(spark):
    """No keys, values from equal to far apart."""
    draw = np.random.default_rng(3)
    values = np.concatenate([draw.normal(0, 1e-7, 30_000), np.full(20_000, 5.0), 10.0 ** draw.uniform(-300, 300, 10_000), [np.inf, np.inf, -0.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    (row,) = exact_quantiles(df, [], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()
    ordered = np.sort(values)
    for i, p in enumerate((0.0, 0.25, 0.5, 0.9, 1.0)):
        at = p * (len(ordered) - 1)
        low, high, share = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)], at - int(at)
        want = low if low == high else low * (1 - share) + high * share
        assert row[f"_p{i}"] == pytest.approx(want, rel=1e-12, abs=0)
    assert row.n == len(values)


def test_quantiles_keep_null_groups(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("k"), (F.col("id") * 0.5).alias("v"))
    got = {r.k: (r.n, r._p0) for r in exact_quantiles(rows, ["k"], "v", (0.5,)).collect()}
    assert set(got) == {None, 0, 1, 2} and got[None] == (10_000, 5000.0)


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    results = []
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(tuple(r) for r in A.summarize(df, ["k"], "v").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_draw_alignment_is_a_permutation_that_keeps_rows(spark):
    df = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").alias("draw_index"), (F.col("id") * 2).alias("x"))
    out = J.align_draws(df, ["source"], 9).collect()
    assert sorted(r.target_index for r in out) == list(range(1000))
    assert all(r.x == 2 * r.draw_index for r in out)
    assert [r.target_index for r in sorted(out, key=lambda r: r.draw_index)] != list(range(1000))


# --- ledger ---------------------------------------------------------------------------------------------


def test_snapshot_respects_the_second_of_recording(spark):
    row = [("k", "r1", datetime(2026, 7, 1, 19), date(2026, 1, 1), None, "asserted")]
    df = spark.createDataFrame(row, "claim_key string, revision_id string, recorded_at timestamp, valid_from date, valid_to date, status string")
    cutoffs = [("before", datetime(2026, 7, 1, 18, 59, 59), date(2026, 7, 1)), ("at", datetime(2026, 7, 1, 19), date(2026, 7, 1))]
    assert [r.cutoff for r in J.eligible_revisions(df, cutoffs).collect()] == ["at"]


def test_a_retraction_hides_older_revisions(spark):
    rows = [("k", "r1", datetime(2026, 1, 1), "asserted"), ("k", "r2", datetime(2026, 1, 2), "retracted"), ("j", "r3", datetime(2026, 1, 1), "asserted")]
    df = spark.createDataFrame(rows, "claim_key string, revision_id string, recorded_at timestamp, status string")
    assert [r.revision_id for r in W.latest_revision(df, ["claim_key"]).collect()] == ["r3"]


def test_closure_reports_cycles_and_missing_parents(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("d", "e"), ("d", "f"), ("e", "g"), ("f", "g")], "claim_id string, depends_on string")
    nodes = spark.createDataFrame([(c,) for c in "abcxdefg"], "claim_id string")
    seeds = spark.createDataFrame([("a",), ("x",), ("d",)], "seed_id string")
    out = J.claim_closure(edges, seeds, nodes).collect()
    reached = {s: sorted(r.claim_id for r in out if r.seed_id == s) for s in "axd"}
    assert reached == {"a": ["a", "b", "c"], "x": ["x", "y"], "d": ["d", "e", "f", "g"]}
    assert {r.seed_id for r in out if r.reaches_itself} == {"a"}
    assert [(r.seed_id, r.claim_id) for r in out if r.missing] == [("x", "y")]


# --- scores -----------------------------------------------------------------------------------------------


def test_triangle_event_score(spark):
    p = one(spark, p=M.triangular_event_probability(F.lit(80.0), F.lit(100.0), F.lit(120.0), F.lit("at_least"), F.lit(105.0)))
    assert p == pytest.approx(0.28125)
    assert one(spark, b=M.brier(F.lit(0.28125), F.lit(True))) == pytest.approx((0.28125 - 1) ** 2)
    assert one(spark, p=M.triangular_event_probability(F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit("at_least"), F.lit(100.0))) == 1.0


def test_scorecard_guards_mixed_units(spark):
    forecasts = spark.createDataFrame([("a", 80.0, 100.0, 120.0), ("b", 80.0, 100.0, 120.0)], "forecast_id string, p10 double, p50 double, p90 double")
    outcomes = spark.createDataFrame(
        [("a", 110.0, "die", "logic", "f", "at_least", 105.0), ("b", 130.0, "stack", "memory", "f", "at_least", 105.0)],
        "forecast_id string, actual_value double, unit string, metric_class string, source_family string, operator string, threshold double",
    )
    scores = R.score_forecasts(forecasts, outcomes)
    assert {r.forecast_id: r.signed_error for r in scores.collect()} == {"a": -10.0, "b": -30.0}
    card = {(r["grouping"], r["group"]): r for r in R.scorecard(scores, 10).collect()}
    assert card["overall", "all"].coverage_rate == 0.5
    assert card["overall", "all"].mean_signed_error is None
    assert card["metric_class", "logic"].mean_signed_error == -10.0
    assert card["metric_class", "logic"].proposal_status == "insufficient_history"
    assert card["metric_class", "logic"].additional_outcomes_needed == 9
    assert card["source_family", "f"].proposal_status == "diagnostic_only"


def test_published_guidance_scores(spark):
    rows = [("revenue", 32.75, 33.5, 34.25, 41.456), ("margin", 0.81, 0.81, 0.81, 0.846), ("eps", 18.5, 18.9, 19.3, 24.67)]
    df = spark.createDataFrame(rows, "id string, low double, midpoint double, high double, actual_value double")
    got = {r.id: r for r in R.score_guidance(df).collect()}
    assert got["revenue"].signed_error == pytest.approx(-7.956)
    assert got["revenue"].surprise_direction == "above_range"
    assert got["revenue"].actual_to_midpoint_ratio == pytest.approx(1.237492537313433)
    assert got["revenue"].normalized_absolute_error == pytest.approx(10.608)
    assert got["margin"].normalization_scale == pytest.approx(0.0081)
    assert got["eps"].interval_miss == pytest.approx(5.37)
    assert got["eps"].normalized_absolute_error == pytest.approx(14.425)


def test_frozen_scorecard_row(spark):
    """A published score row: quantiles, actual and the event decide every other number."""
    row = [(1734305.4468499569, 2061372.756143557, 2391256.7529388857, 1896462.9356520725, "at_least", 1958304.118336379)]
    got = R.score_rows(spark.createDataFrame(row, "p10 double, p50 double, p90 double, actual_value double, operator string, threshold double")).first()
    assert got.normalized_absolute_error == pytest.approx(0.5020457953672481)
    assert got.mean_pinball_loss == pytest.approx(49383.34695154502)
    assert got.event_probability == pytest.approx(0.7664818901842249)
    assert got.brier_score == pytest.approx(0.5874944879803822)


# --- conversion, power, earnings ------------------------------------------------------------------------------


def test_power_bridge_known_case(spark):
    values = dict(gross=100.0, current_load=20.0, contracted_reservations=10.0, other_commitments=5.0, incompatible_capacity=5.0, target_share=0.5, rack_load=0.1, commissioning_slots=200.0, completion_ratio=0.5)
    got = C.power_bridge(spark.createDataFrame([values])).first()
    assert (got.residual_power, got.target_power, got.power_limited_racks) == pytest.approx((60, 30, 300))
    assert (got.commissioned_racks, got.operational_racks, got.shadow_power) == pytest.approx((100, 100, 20))
    assert (got.binding.power, got.binding.commissioning) == (0.0, 1.0)
    got = C.power_bridge(spark.createDataFrame([{**values, "current_load": 120.0}])).first()
    assert (got.residual_power, got.oversubscribed, got.operational_racks) == pytest.approx((0, 40, 0))


def test_earnings_known_case(spark):
    line = dict(company_id="c", source_units=100.0, units_per_source_unit=1.0, attributable_share=1.0, beginning_inventory=10.0, ending_inventory=20.0, recognition_share=1.0, unit_price_local=10.0, fx_usd_per_local=1.0, gross_margin=0.5)
    company = dict(company_id="c", rest_revenue=100.0, rest_gross_margin=0.5, operating_expenses=200.0, nonoperating_expense=10.0, tax_rate=0.2, diluted_shares=100.0)
    got = E.line_results(spark.createDataFrame([line])).first()
    assert (got.produced_units, got.available_units, got.shipped_units, got.revenue_usd) == (100, 110, 90, 900)
    got = E.earnings_bridge(spark.createDataFrame([line]), spark.createDataFrame([company]), ["company_id"]).first()
    assert (got.total_revenue, got.eps) == pytest.approx((1000, 2.32))


def test_named_cases_flip_adverse_inputs(spark):
    df = spark.range(1).select(F.struct(F.lit(1.0).alias("low"), F.lit(2.0).alias("base"), F.lit(3.0).alias("high")).alias("x"))
    rows = P.named_cases(df).select("case", P.case_value("x").alias("n"), P.case_value("x", "adverse_bound").alias("a")).collect()
    assert {r.case: (r.n, r.a) for r in rows} == {"bear": (1, 3), "base": (2, 2), "bull": (3, 1)}


def test_supplier_pool_criticality(spark):
    flows = V.supplier_flows(spark.createDataFrame([("s", 0, "x", 60.0, 1.0, 1.0), ("s", 0, "y", 40.0, 1.0, 1.0)], "s string, d int, supplier string, good_stacks double, qualified_share double, allocation_share double"))
    for demand, limited, supported in ((12.0, False, 12.0), (20.0, True, 12.5)):
        dm = spark.createDataFrame([("s", 0, demand, 8.0)], "s string, d int, package_demand double, stacks_per_accelerator double")
        out = V.supplier_pool(flows, dm, ["s"], "d", "supplier")
        total = out["totals"].first()
        assert (total.limited, total.packages_supported) == (limited, supported)
        assert sum(r.allocated_share for r in out["suppliers"].collect()) == pytest.approx(1)
        assert all(r.criticality_probability == 1.0 for r in out["criticality"].collect())


def test_die_geometry_is_monotone(spark):
    wide = lambda w: one(spark, d=M.gross_dies_per_wafer(F.lit(300.0), F.lit(3.0), F.lit(w), F.lit(25.0), F.lit(0.1)))
    assert wide(10.0) > wide(20.0) > wide(30.0) > 0
    y = one(spark, y=M.negative_binomial_yield(F.lit(0.1), F.lit(800.0), F.lit(2.5)))
    assert 0 < y < 1 and y == pytest.approx((1 + 0.1 * 8 / 2.5) ** -2.5)


# --- imports and text --------------------------------------------------------------------------------------------


def test_capacity_import_sums_ranges(spark):
    rows = [("a", 80.0, 100.0, 125.0, 0.82, "source_statement"), ("b", 40.0, 50.0, 65.0, 0.71, "estimate")]
    capacity = spark.createDataFrame(rows, "claim_id string, low double, base double, high double, confidence double, claim_kind string").select(
        "*", F.lit("m").alias("metric"), F.lit("u").alias("unit"), F.lit("b").alias("basis"), F.lit("2026-07-01").cast("date").alias("period_start"), F.lit("2026-10-01").cast("date").alias("period_end")
    )
    selection = spark.createDataFrame([("s", ["a", "b"], "m", "u", "b", "2026-Q3")], "selection_id string, claim_ids array<string>, metric string, unit string, basis string, target_quarter string")
    total, failed = D.import_capacity(capacity, selection)
    got = total.first()
    assert (got.low, got.base, got.high, got.confidence, got.posture) == (120, 150, 190, 0.71, "derived")
    assert failed.isEmpty()


HTML = "<html><head><style>HBM{}</style><script>var x='HBM';</script></head><body><p>HBM supply &amp; <b>hbm</b> demand</p><noscript>HBM</noscript><p>CoWoS</p></body></html>"


def test_visible_text_and_hit_limit(spark):
    docs = spark.createDataFrame([(1, HTML)], "id int, html string").select("id", X.visible_text("html").alias("text"))
    assert docs.first().text == "HBM supply & hbm demand CoWoS"
    terms = [{"term_id": "hbm", "category": "memory", "literal": "HBM"}, {"term_id": "cowos", "category": "package", "literal": "cowos"}]
    full = D.index_terms(docs, "id", "text", terms, 5, 10)
    hits = full["hits"].collect()
    text = docs.first().text
    assert len(hits) == 3
    assert all(text[r.character_start : r.character_end].lower() == r.literal.lower() for r in hits)
    capped = D.index_terms(docs, "id", "text", terms, 5, 1)
    assert capped["hits"].count() == 2
    assert capped["documents"].first().truncated_hit_count == 1


def test_offsets_count_code_points(spark):
    text = "𝛼é Tion 𝛽 tion.tion"
    rows = one(spark, s=X.literal_spans(F.lit(text), F.lit("TION")))
    assert [text[r.character_start : r.character_end].lower() for r in rows] == ["tion"] * 3
    assert one(spark, s=X.literal_spans(F.lit("a.b*a.b"), F.lit(".b"))) and len(one(spark, s=X.literal_spans(F.lit("axb"), F.lit(".b")))) == 0


def test_sampled_values_share_a_correlation_group(spark):
    rows = [("a", "g", 0.0, 1.0, 2.0), ("b", "g", 0.0, 1.0, 2.0), ("c", None, 0.0, 1.0, 2.0), ("d", None, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "estimate_id string, correlation_group string, low double, base double, high double")
    out = {(r.estimate_id, r.draw_index): r.value for r in J.expand_draws(df, 400, 1).collect()}
    assert all(out["a", i] == out["b", i] for i in range(400))
    assert any(out["a", i] != out["c", i] for i in range(400))
    assert all(out["d", i] == 3.0 for i in range(400))
    assert math.isclose(sum(out["c", i] for i in range(400)) / 400, 1.0, abs_tol=0.1)


def _fill_by_hand(demand, weight, capacity, need):
    """Round by round on plain floats, until nobody is active."""
    output = [0.0] * len(demand)
    active = {p for p in range(len(demand)) if demand[p] > 0 and weight[p] > 0}
    used = lambda r: sum(need[p][r] * output[p] for p in range(len(demand)))
    while active:
        steps = [(demand[p] - output[p]) / weight[p] for p in active]
        for r in range(len(capacity)):
            pull = sum(need[p][r] * weight[p] for p in active)
            if pull > 1e-10:
                steps.append(max(0.0, capacity[r] - used(r)) / pull)
        step = max(0.0, min(steps))
        for p in active:
            output[p] = min(demand[p], output[p] + weight[p] * step)
        leaving = {p for p in active if demand[p] - output[p] <= 1e-10 * max(1.0, demand[p])}
        for r in range(len(capacity)):
            if capacity[r] - used(r) <= 1e-10 * max(1.0, capacity[r]):
                leaving |= {p for p in active if need[p][r] > 0}
        if not leaving and step <= 1e-10:
            break
        active -= leaving
    return output


@pytest.mark.parametrize("scale", [1e2, 1e4, 1e6, 1e8])
def test_fill_goes_on_until_nobody_is_active(scale):
    from tallyforge.plans.capacity import _fill_stage

    draw = np.random.RandomState(int(np.log10(scale)))
    demand = draw.rand(1500, 5) * scale * 0.6
    weight, capacity = draw.rand(1500, 5) * 3 + 0.01, draw.rand(1500, 3) * scale
    need = draw.rand(1500, 5, 3) * (draw.rand(1500, 5, 3) < 0.6)
    filled, _ = _fill_stage(demand, weight, capacity, need, 1e-10)
    wanted = np.array([_fill_by_hand(list(d), list(w), list(c), n.tolist()) for d, w, c, n in zip(demand, weight, capacity, need)])
    assert np.abs(filled - wanted).max() <= 1e-6 * scale
    assert (np.einsum("gpr,gp->gr", need, filled) <= capacity * (1 + 1e-9)).all()


def test_fill_keeps_groups_without_pools(spark):
    from tallyforge.plans.capacity import chain_fill, fill_groups

    platforms = spark.createDataFrame([(1, "a", 5.0, 1.0), (2, "a", 5.0, 1.0)], "g long, platform_id string, demand double, weight double")
    pools = spark.createDataFrame([(1, 1, "p", 2.0)], "g long, stage_rank int, pool_id string, capacity double")
    needs = spark.createDataFrame([(1, "a", "p", 1.0)], "g long, platform_id string, pool_id string, units double")
    got = chain_fill(fill_groups(platforms, pools, needs, ["g"]), ["g"], [1]).collect()
    assert {r.g: (r.output, r.blockers) for r in got} == {1: (2.0, ["p"]), 2: (5.0, [])}


def test_water_fill_without_total_is_the_same_in_both_forms(spark):
    from tallyforge.operators.windows import water_fill

    rows = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 7.0)], "g long, cap double").selectExpr("*", "1.0D AS weight")
    totals = spark.createDataFrame([(1, 2.0)], "g long, total double")
    results = [sorted(map(tuple, water_fill(rows, totals, ["g"], "weight", "cap", bounded=b).collect())) for b in (True, False)]
    assert results[0] == results[1] and (2, 7.0, 1.0, 7.0) in results[0]


def test_replayed_batch_adds_nothing(spark, tmp_path):
    from tallyforge.schemas import table as schema_of
    from tallyforge.sources import ledger

    schema = schema_of(claim_key="bigint", revision_id="bigint", recorded_at="timestamp", value="double", supersedes_revision_id="bigint")
    rows = spark.createDataFrame([(1, 10, datetime(2024, 1, 1), 1.0, None), (1, 11, datetime(2024, 1, 2), 2.0, 10)], schema)
    root = str(tmp_path / "ledger")
    append = lambda df, name: ledger.append_ledger(spark, root, "revisions", schema, df, name)
    ledger.write_batch(rows.limit(1), root, "revisions", "b1")  # written, but the job ended before it was committed
    assert ledger.read_ledger(spark, root, "revisions", schema).count() == 0
    for _ in range(3):
        assert append(rows, "b1")["committed"]
        assert ledger.read_ledger(spark, root, "revisions", schema).count() == 2
    changed = append(rows.withColumn("value", F.lit(9.0)), "b2")
    assert not changed["committed"] and {r.code for r in changed["problems"].collect()} == {"revision_collision"}
    assert append(rows, "b3")["committed"] and ledger.read_ledger(spark, root, "revisions", schema).count() == 2


def test_visible_text_rules(spark):
    from tallyforge.functions.text import visible_text

    page = "<style>p{}</style>A&amp;B <!-- x > y --><b title='a>b'>bold</b>&#233;&#x1F600;&lt;i&gt;<script>1 < 2</script> 3 < 4 &nbsp; end<noscript>no"
    rows = spark.createDataFrame([(page,), (None,), ("",)], "html string").select(visible_text("html").alias("t")).collect()
    assert [r.t for r in rows] == ["A&B bold é😀<i> 3 < 4 end", None, ""]


def test_required_keys(spark, tmp_path):
    from tallyforge.schemas import table as schema_of
    from tallyforge.sources.readers import read_jsonl

    (tmp_path / "a.jsonl").write_text('{"key": 1}\n{"key": 2, "nation": 3}\n{"nation": 1}\n')
    rows, rejects = read_jsonl(spark, f"file://{tmp_path}/a.jsonl", schema_of(("key", "nation"), key="bigint", nation="int"))
    assert [tuple(r) for r in rows.collect()] == [(2, 3)]
    assert sorted(r.reason for r in rejects.collect()) == ["missing_fields:key", "missing_fields:nation"]


def test_quantiles_of_awkward_groups(spark):
    draw = random.Random(9)
    groups = {k: [draw.random() for _ in range(k)] for k in (1, 2, 3, 4, 5, 7, 10, 11, 12, 25)}
    groups |= {100: [3.0] * 50, 101: [draw.random() * 1e-8 for _ in range(500)], 102: [float(draw.randint(0, 3)) for _ in range(999)]}
    groups[103] = [draw.gauss(0, 1) for _ in range(30_000)]
    rows = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "g long, v double")
    got = exact_quantiles(rows, ["g"], "v", (0.1, 0.5, 0.9, 0.0, 1.0)).collect()
    assert len(got) == len(groups)
    for r in got:
        wanted = np.quantile(groups[r.g], [0.1, 0.5, 0.9, 0.0, 1.0])
        assert np.allclose([r._p0, r._p1, r._p2, r._p3, r._p4], wanted, rtol=1e-12, atol=0)


def test_quantiles_of_values_that_change_when_computed_again(spark):
    jitter = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(2_100).select((F.col("id") % 100).alias("g"), jitter(F.col("id").cast("double")).alias("v"))
    for small in (1, 1_000):
        got = exact_quantiles(rows, ["g"], "v", (0.1, 0.5, 0.9), small).collect()
        assert len(got) == 100 and all(abs(r._p1 - (r.g + 1_000)) < 1e-8 for r in got)


def test_hot_and_small_groups_have_the_same_quantiles(spark):
    draw = random.Random(4)
    values = [(None if k == 3 else k, float(draw.randint(-9, 9)) / 3) for k in range(5) for _ in range(37 * k + 1)] + [(7, float("inf")), (7, -0.0), (8, None)]
    rows = spark.createDataFrame(values, "g long, v double")
    one, other = (sorted(exact_quantiles(rows, ["g"], "v", (0.1, 0.5, 0.9), small).collect(), key=str) for small in (0, 1_000))
    assert len(one) == 6
    assert [[x if x is None else pytest.approx(x, rel=1e-12, nan_ok=True) for x in r] for r in one] == [list(r) for r in other]


def test_visible_text_of_long_tags_and_bad_references(spark):
    long = "<p data-x='" + "y" * 1_000_000 + "' " + "a=b " * 250_000 + ">"
    pages = [f"one{long}two", "a <b unclosed " + "x" * 100_000, "&#9999999;&#xD800;&#0;&#99999999999999;&#x110000;&#0065;&#x0041;&#x10FFFF;", "<b '" + "q" * 100_000, "<" * 3_000 + "z"]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string").select("id", X.visible_text("html").alias("t")).orderBy("id").collect()
    assert rows[0].t == "one two" and rows[1].t == pages[1] and rows[2].t == "\ufffd" * 5 + "AA\U0010ffff" and rows[3].t == pages[3] and rows[4].t.endswith("z")


def test_many_hits_keep_their_places(spark):
    from time import perf_counter

    text = "".join("é" * (i % 4) + "hbm" for i in range(200_000))
    spans = lambda *texts: spark.createDataFrame([(t,) for t in texts], "t string").select(F.explode(X.literal_spans("t", F.lit("hbm"))).alias("s")).select("s.*").collect()
    start = perf_counter()
    got = spans(text)
    assert perf_counter() - start < 60
    places, at = [], 0
    for i in range(200_000):
        at += i % 4
        places.append((i + 1, at, at + 3))
        at += 3
    assert [tuple(r) for r in got] == places
    assert [tuple(r) for r in spans("none", "HBM", "")] == [(1, 0, 3)]


def test_cycles_and_closures_of_selections(spark):
    from tallyforge.operators.joins import closure_per_selection, cyclic_claims

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 7), (7, 7), (3, 8), (8, 9), (9, None)], "claim_id int, depends_on int")
    assert sorted(r.claim_id for r in cyclic_claims(edges).collect()) == [1, 2, 3, 7]
    selected = spark.createDataFrame([("a", 4), ("b", 6), ("b", 5)], "selection_id string, claim_id int")
    got = closure_per_selection(edges.where("depends_on IS NOT NULL"), selected).collect()
    assert sorted(map(tuple, got)) == [("a", i) for i in (1, 2, 3, 4, 8, 9)] + [("b", i) for i in (5, 6, 7)]


def test_evidence_of_a_selection(spark):
    selections = spark.createDataFrame([("ok", [1]), ("lost", [4]), ("round", [5]), ("bare", [3]), ("bad", [6])], "selection_id string, claim_ids array<int>")
    claims = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "claim_id int")
    edges = spark.createDataFrame([(1, 2), (4, 99), (5, 5)], "claim_id int, depends_on int")
    link = lambda i, claim, document, role="support", publisher="nist": (i, claim, document, role, "u" + i, publisher, "2024-01-01", "f")
    rows = [link("a", 1, "d1"), link("b", 2, "d2"), link("c", 2, "d1", "contrast"), link("d", 4, "d1"), link("e", 5, "d1"), link("f", 6, "gone"), link("g", 6, "d1", publisher=" "), link("h", 6, "twice")]
    evidence = spark.createDataFrame(rows, "link_id string, claim_id int, document_id string, role string, document_url string, publisher string, retrieved_at string, source_family string")
    documents = spark.createDataFrame([("d1", "Title"), ("d2", " "), ("twice", "x"), ("twice", "y")], "document_id string, title string")
    found, wrong = D.capacity_evidence(selections, claims, edges, evidence, documents)
    assert sorted((r.selection_id, r.link_id, r.title, r.kind) for r in found.collect()) == [("ok", "a", "Title", "government_record"), ("ok", "b", "ub", "government_record")]
    assert sorted((r.selection_id, r.key or "", r.problem) for r in wrong.collect()) == [
        ("bad", "f", "document_missing"), ("bad", "g", "publisher_missing"), ("bad", "h", "document_not_unique"), ("bare", "", "no_support"), ("lost", "99", "claim_missing"), ("round", "5", "dependency_cycle")
    ]


def test_collisions_see_which_field_is_null(spark, tmp_path):
    from tallyforge.sources.ledger import append_ledger

    row = lambda a, b: spark.sql(f"SELECT 'r' AS revision_id, {a} AS a, {b} AS b, TIMESTAMP'2024-01-02' AS recorded_at")
    one, other = row("DATE'2024-01-01'", "CAST(NULL AS DATE)"), row("CAST(NULL AS DATE)", "DATE'2024-01-01'")
    fields = one.schema
    assert append_ledger(spark, f"file://{tmp_path}", "t", fields, one, "b1", check_chain=False)["committed"]
    assert not append_ledger(spark, f"file://{tmp_path}", "t", fields, other, "b2", check_chain=False)["committed"]


def cycle_rows(spark, values):
    from tallyforge.schemas import CYCLE_REVISIONS

    day = datetime(2024, 1, 2)
    rows = [(key, rid, at or day, float(rid), date(2024, 1, 1), None, "asserted", before) for key, rid, at, before in values]
    return spark.createDataFrame(rows, CYCLE_REVISIONS)


def test_cycle_repeats_nothing_wherever_it_stops(spark, tmp_path, monkeypatch):
    from tallyforge.streaming import cycle as Y

    known, valid = datetime(2024, 1, 3), date(2024, 1, 2)
    batch = cycle_rows(spark, [(1, 10, None, None), (2, 11, None, None)])

    def stop(*args, **kwargs):
        raise KeyError("stopped")

    def sent(root):
        return sorted(r.event_id for r in spark.read.schema("event_id string").json(f"{root}/sink/*").collect())

    for place, name in enumerate(("append_ledger", "claim_diff", "enqueue_notifications", "deliver_jsonl")):
        root = f"file://{tmp_path}/{place}"
        with monkeypatch.context() as patch:
            patch.setattr(Y, name, stop)
            with pytest.raises(KeyError):
                Y.run_cycle_batch(batch, 0, root, known, valid, f"{root}/sink")
        Y.run_cycle_batch(batch, 0, root, known, valid, f"{root}/sink")
        assert len(sent(root)) == len(set(sent(root))) == 2
    once = sent(root)
    Y.run_cycle_batch(batch, 0, root, known, valid, f"{root}/sink")  # handed over, and stopped before the checkpoint
    assert sent(root) == once
    Y.run_cycle_batch(cycle_rows(spark, [(3, 12, datetime(2024, 1, 4), None)]), 1, root, datetime(2024, 1, 5), valid, f"{root}/sink")
    assert len(sent(root)) == 3 and set(once) < set(sent(root))


def test_refused_pack_is_offered_again(spark, tmp_path):
    from tallyforge.streaming import cycle as Y

    root, known, valid = f"file://{tmp_path}", datetime(2024, 1, 3), date(2024, 1, 2)
    (tmp_path / "packs").mkdir()
    cycle_rows(spark, [(1, 10, None, 9)]).toPandas().to_parquet(tmp_path / "packs" / "a.parquet", coerce_timestamps="us")
    with pytest.raises(Exception, match="PackRefused"):
        Y.run_cycle(spark, f"{root}/packs", root, known, valid)
    assert spark.read.parquet(f"{root}/problems/run=0").first().code == "first_revision_supersedes"
    cycle_rows(spark, [(1, 10, None, None)]).toPandas().astype({"supersedes_revision_id": "Int64"}).to_parquet(tmp_path / "packs" / "a.parquet", coerce_timestamps="us")
    Y.run_cycle(spark, f"{root}/packs", root, known, valid)
    assert spark.read.parquet(f"{root}/revisions").count() == 1


def test_filings_are_added_once_and_only_their_days_are_read(spark, tmp_path):
    from tallyforge.schemas import table
    from tallyforge.streaming.cycle import add_filings

    schema, target = table(accession_number="string", day="date"), f"file://{tmp_path}/out"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    a, b, c, none = ("a", date(2024, 1, 1)), ("b", date(2024, 1, 2)), ("c", date(2024, 2, 1)), ("n", None)
    for _ in range(2):  # a replay of the first run changes nothing
        add_filings(rows(a, a, b, none), 0, target, schema, "day")
    add_filings(rows(b, c, none), 1, target, schema, "day")
    add_filings(rows(a), 2, target, schema, "day")
    got = spark.read.schema("accession_number string, day date, run bigint").parquet(target).select("accession_number", "run").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("b", 0), ("c", 1), ("n", 0)]


def test_pack_is_visible_whole_or_not_at_all(spark, tmp_path):
    from tallyforge.functions.values import CORE_DIMENSIONS
    from tallyforge.sources import ledger

    root, day = f"file://{tmp_path}", "TIMESTAMP'2024-01-02'"
    names = ", ".join(f"'{n}'" for n in CORE_DIMENSIONS)
    pack = {
        "revisions": spark.sql(f"SELECT 1L AS claim_key, 'r' AS revision_id, {day} AS recorded_at, 1.0D AS value, CAST(NULL AS STRING) AS supersedes_revision_id, 'asserted' AS status, DATE'2024-01-01' AS valid_from, CAST(NULL AS DATE) AS valid_to, 0.5D AS confidence"),
        "edges": spark.sql("SELECT 'r' AS revision_id, 's' AS snapshot_id, 'primary' AS evidence_role"),
        "snapshots": spark.sql("SELECT 's' AS snapshot_id, 'h' AS content_sha256, TIMESTAMP'2024-01-01' AS retrieved_at"),
        "dimensions": spark.sql(f"SELECT 'r' AS revision_id, explode(array({names})) AS dimension, 'all' AS value"),
    }
    counts = lambda: [ledger.read_ledger(spark, root, t, pack[t].schema).count() for t in ledger.PACK_KEYS]
    late = {**pack, "snapshots": pack["snapshots"].withColumn("retrieved_at", F.lit("2024-01-03").cast("timestamp"))}
    refused = ledger.append_pack(spark, root, late, "p0")
    assert {r.code for r in refused["problems"].collect()} == {"retrieved_after_recording"} and counts() == [0, 0, 0, 0]
    ledger.write_batch(pack["revisions"], root, "revisions", "p1")  # one table written, then the job ended
    assert counts() == [0, 0, 0, 0]
    for name in ("p1", "p1", "p2"):
        assert ledger.append_pack(spark, root, pack, name)["committed"] and counts() == [1, 1, 1, 6]
    changed = {**pack, "dimensions": pack["dimensions"].where("dimension <> 'stage'").withColumn("value", F.when(F.col("dimension") == "period", "q").otherwise(F.col("value")))}
    refused = ledger.append_pack(spark, root, changed, "p3")
    assert {(r.table, r.code) for r in refused["problems"].collect()} == {("dimensions", "collision"), ("dimensions", "missing:stage")}
    plan = ledger.read_ledger(spark, root, "revisions", pack["revisions"].schema, until=datetime(2024, 1, 1))
    assert plan.count() == 0 and "recorded_date" in plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_files_of_a_batch_follow_its_days_not_its_tasks(spark, tmp_path):
    from tallyforge.sources import ledger

    rows = spark.range(0, 4000, 1, 40).select("id", F.timestamp_add("DAY", (F.col("id") % 3).cast("int"), F.lit(datetime(2024, 1, 1))).alias("recorded_at"))
    ledger.write_batch(rows, f"file://{tmp_path}", "t", "b1")
    assert len(list(tmp_path.glob("t/batch_id=b1/*/*.parquet"))) == 3  # 120 when each task wrote its own


@pytest.mark.parametrize("chunk_rows", [100, 1 << 20])
def test_lag_cuts_only_keys_with_many_rows(spark, chunk_rows):
    draw = random.Random(5)
    rows = [(draw.choice(["hot"] * 8 + ["a", "b"]), draw.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = {r.i: r.p for r in chunked_lag(df, ["k"], ["t", "i"], None, {"p": "i"}, chunk_rows).collect()}
    for key in ("hot", "a", "b"):
        mine = [i for _, _, i in sorted(r for r in rows if r[0] == key)]
        assert [got[i] for i in mine] == [None, *mine[:-1]]


def test_marks_of_a_batch_against_the_ledger(spark):
    from tallyforge.sources.ledger import new_and_colliding

    shape = "k int, a string"
    known = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], shape)
    batch = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None), (4, "n"), (5, "p"), (5, None)], shape)
    whole, fresh, colliding = new_and_colliding(known, batch, ["k"], ["k", "a"])
    assert whole.count() == 6 and sorted(r.k for r in fresh.collect()) == [4, 5, 5] and sorted(r.k for r in colliding.collect()) == [2, 3, 5]


def test_pool_fill_moves_the_rows_of_an_order_once(spark):
    from tallyforge.catalog import Tables
    from tallyforge.catalog.capacity import pool_inputs

    keys, platforms, pools, needs = pool_inputs(Tables(spark, "/root/testdata/sf0.001"))
    filled = C.chain_fill(C.fill_groups(platforms, pools, needs, keys), keys, [0, 1, 2, 3, 4])
    filled.write.format("noop").mode("overwrite").save()
    plan = filled._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_orderkey" in line]
    assert moves and all("REPARTITION_BY_COL" in line for line in moves)  # no group or join by order moves them again


def test_fill_of_mixed_shapes_is_that_of_each_group(spark):
    draw = random.Random(9)
    platforms, pools, needs = [], [], []
    for g in range(40):
        names = [f"p{i}" for i in range(draw.randint(1, 4))]
        platforms += [(g, n, draw.uniform(1, 9), draw.uniform(1, 3)) for n in names]
        for r in range(draw.randint(0, 3)):
            pools.append((g, r % 2, f"r{r}", draw.uniform(1, 9)))
            needs += [(g, n, f"r{r}", 1.0) for n in names if draw.random() < 0.7]
    frames = lambda some: (
        spark.createDataFrame([r for r in platforms if r[0] in some], "g int, platform_id string, demand double, weight double"),
        spark.createDataFrame([r for r in pools if r[0] in some], "g int, stage_rank int, pool_id string, capacity double"),
        spark.createDataFrame([r for r in needs if r[0] in some], "g int, platform_id string, pool_id string, units double"),
    )
    run = lambda some: {(r.g, r.stage_rank, r.platform_id): (r.demand, r.output, tuple(r.blockers)) for r in C.chain_fill(C.fill_groups(*frames(some), ["g"]), ["g"], [0, 1]).collect()}
    whole = run(set(range(40)))
    assert len(whole) == 2 * len(platforms) and any(b for _, _, b in whole.values())
    for g in (0, 7, 23):
        alone = run({g})
        assert all(whole[k][2] == v[2] and whole[k][:2] == pytest.approx(v[:2]) for k, v in alone.items())


def scratch_folders(spark, label):
    from pathlib import Path

    from tallyforge.session import shared_dir

    return sorted(Path(shared_dir(spark).removeprefix("file:")).glob(f"{label}-*"), key=lambda p: p.stat().st_mtime)


@pytest.mark.parametrize("name, label, files", [("p3_flatten_paths", "paths", "depth=0/*.parquet"), ("sk4_build_manifest", "pages", "page_id=*/*.txt")])
def test_a_table_of_one_split_is_worked_on_by_many_tasks(spark, name, label, files):
    from tallyforge.catalog import Tables, load

    assert not load()[name].run(Tables(spark, "/root/testdata/sf0.001")).isEmpty()
    tasks = {p.name.split("-")[1] for p in scratch_folders(spark, label)[-1].glob(files)}
    assert len(tasks) > 4  # one before


def test_events_are_made_after_their_alerts_are_dealt_out(spark):
    from tallyforge.streaming.outbox import notification_events

    events = notification_events(spark.range(10).select("id", F.lit("x").alias("type")), F.lit("2024-02-01").cast("timestamp"))
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.index("payload_json") < plan.index("REPARTITION_BY_COL")  # the tree is printed from its top


def test_anchors_are_judged_once_for_all_outputs(spark):
    when = F.lit("2024-01-01").cast("timestamp")
    texts = spark.createDataFrame([(1, "abcdef"), (2, "ghijkl"), (3, "mnopqr")], "accession_number long, text string").withColumn("retrieved_at", when)
    specs = spark.createDataFrame(
        [(10, 1, 1, 3, "bc"), (11, 1, 0, 1, "a"), (12, 2, 0, 2, "xx"), (13, 2, 4, 9, "kl"), (14, 9, 0, 1, "a"), (15, 3, 0, 2, "mn")],
        "spec_id long, accession_number long, character_start int, character_end int, expected_text string",
    )
    claims, failed = D.anchor_claims(texts, specs, F.lit("2024-02-01").cast("timestamp"))
    assert {(r.spec_id, r.source_id) for r in claims.collect()} == {(10, "sec-filing-1"), (11, "sec-filing-1"), (15, "sec-filing-3")}
    assert {tuple(r) for r in failed.collect()} == {(12, "anchor_mismatch"), (13, "anchor_exceeds_document"), (14, "document_absent")}
    documents = spark.createDataFrame([(1, "h", "h"), (3, "h", "other")], "accession_number long, content_sha256 string, source_sha256 string")
    fixed = {"media_type": F.lit("text/html"), "source_url": F.lit("u"), "filing_date": F.lit("2023-12-01").cast("date"), "retrieved_at": when}
    rows, edges, problems = D.anchored_evidence(claims, documents.withColumns(fixed))
    assert [r.id for r in rows.collect()] == ["sec-filing-1"] and edges.count() == 2
    assert [tuple(r) for r in problems.collect()] == [(3, "source_hash_mismatch")]
    for out in (claims, failed, rows, edges, problems):  # none goes back to the texts
        assert out.inputFiles() and all("/anchors-" in f or "/filings-" in f for f in out.inputFiles())


def test_customers_of_a_draw_are_computed_once(spark):
    rows = [("a", d, c, float(1 + c), float(3 * c + d % 4)) for d in range(60) for c in range(d % 5)] + [("a", None, 0, 1.0, 7.0)]
    rules = spark.createDataFrame(rows, "k string, draw_index int, customer_id int, share double, demand_cap double")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    totals = spark.createDataFrame([("a", d, 2.5 * d if d % 7 else -1.0) for d in range(3, 70)] + [("a", None, 5.0)], "k string, draw_index int, total double")
    group = ["k", "draw_index"]
    filled = W.water_fill(rules, totals, group, "share", "demand_cap", bounded=True)
    left = W.unallocated(filled, totals, group)
    want = [(r.draw_index, r.customer_id, r.allocated, False) for r in filled.collect()] + [(r.draw_index, None, r.unallocated, True) for r in left.collect()]
    out = W.fill_and_rest(rules, totals, group, "share", "demand_cap")
    by = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    got = sorted([(r.draw_index, r.customer_id, r.allocated, r.leftover) for r in out.collect()], key=by)
    assert [(*r[:2], pytest.approx(r[2]), r[3]) for r in sorted(want, key=by)] == got
    C.customer_allocation(totals.withColumnRenamed("total", "output"), rules.mapInArrow(counted, rules.schema), ["k"]).collect()
    assert seen.value == len(rows)


def test_values_are_read_and_sorted_in_bounded_parts(spark, monkeypatch):
    from tallyforge.operators import skew

    monkeypatch.setattr(skew, "VALUE_ROWS", 500, raising=False)
    df = spark.range(0, 6000, 1, 1).select((F.col("id") % 3000).alias("k"), F.col("id").cast("double").alias("v"))
    out = skew.exact_quantiles(df, ["k"], "v", (0.5,))
    assert {(r.k, r._p0) for r in out.collect()} == {(k, k + 1500.0) for k in range(3000)}
    files = [f for f in out.inputFiles() if "/values-" in f]
    assert max(spark.read.parquet(f).count() for f in files) <= 500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan  # groups meet before their values are sorted


def test_lines_are_dealt_out_before_they_are_grouped(spark):
    from tallyforge.catalog import Tables
    from tallyforge.catalog.capacity import earnings_inputs
    from tallyforge.session import SPLIT_BYTES, tune

    lines, _ = earnings_inputs(Tables(spark, "/root/testdata/sf0.001"))
    assert "RebalancePartitions [l_orderkey" in lines._jdf.queryExecution().optimizedPlan().toString()
    before = tune(spark).conf.get(SPLIT_BYTES)
    assert tune(spark, 400).conf.get(SPLIT_BYTES) == "16m"
    assert tune(spark).conf.get(SPLIT_BYTES) == before
