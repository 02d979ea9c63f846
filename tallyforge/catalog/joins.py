"""Joins, set operators and reshaping over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions.maths import settle
from tallyforge.operators import aggregates as A
from tallyforge.operators import joins as J
from tallyforge.operators import ordering as O
from tallyforge.operators import projections as P
from tallyforge.operators import sets as S
from tallyforge.session import spread

from . import query, sq
from .aggregates import six_sql, settled


@query("""SELECT o_orderkey AS revision_id, count(*) AS evidence_count, string_agg(role || ':' || snapshot_id, '|' ORDER BY role, snapshot_id) AS evidence
FROM (SELECT o_orderkey, 'primary' AS role, 'c' || o_custkey AS snapshot_id FROM orders
  UNION ALL SELECT o_orderkey, 'support', 'c' || (o_custkey + 1) FROM orders WHERE o_orderstatus = 'P') e
JOIN (SELECT 'c' || c_custkey AS snapshot_id FROM customer) s USING (snapshot_id) GROUP BY o_orderkey""")
def j1_attach_evidence(t):
    claims = t.orders.select(F.col("o_orderkey").alias("revision_id"))
    listed = F.array(
        F.struct(F.lit("primary").alias("evidence_role"), F.concat(F.lit("c"), "o_custkey").alias("snapshot_id")),
        F.when(
            F.col("o_orderstatus") == "P",
            F.struct(F.lit("support").alias("evidence_role"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("snapshot_id")),
        ),
    )
    edges = t.orders.select(F.col("o_orderkey").alias("revision_id"), F.inline(F.array_compact(listed)))
    snapshots = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("snapshot_id"), F.col("c_name").alias("publisher"))
    out = J.attach_evidence(claims, edges, snapshots).where("evidence IS NOT NULL")
    text = F.concat_ws("|", F.transform("evidence", lambda e: F.concat_ws(":", e["evidence_role"], e["snapshot_id"])))
    return out.select("revision_id", F.size("evidence").cast("bigint").alias("evidence_count"), text.alias("evidence"))


@query("""SELECT c_custkey AS event_id, strftime(max(o_orderdate), '%Y-%m-%d') AS acknowledged_on,
  arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS acknowledged_by FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def j2_with_acknowledgements(t):
    events = t.customer.select(F.col("c_custkey").alias("event_id"))
    acks = t.orders.select(F.col("o_custkey").alias("event_id"), F.col("o_orderdate").alias("acknowledged_at"), F.col("o_orderkey").alias("acknowledged_by"))
    out = J.with_acknowledgements(events, acks)
    return out.select("event_id", F.date_format("acknowledged_at", "yyyy-MM-dd").alias("acknowledged_on"), "acknowledged_by")


def order_sets(t):
    """Previous set: orders before 2000, with two kinds of later change; current set: all but some customers' orders."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    previous = o.where(F.col("o_orderdate") < "2000-01-01").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    current = o.where((F.col("o_orderstatus") != "P") | (F.col("o_orderdate") >= "1996-01-01"))
    return previous, current


ORDER_SETS = """p AS (SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
   FROM orders WHERE o_orderdate < DATE '2000-01-01'),
 c AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' OR o_orderdate >= DATE '1996-01-01')"""


@query(f"WITH {ORDER_SETS} SELECT o_orderkey, o_orderstatus FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p)")
def j4_new_rows(t):
    previous, current = order_sets(t)
    return J.new_rows(current, previous, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query(f"""WITH {ORDER_SETS} SELECT p.o_orderkey, CASE WHEN c.o_orderkey IS NULL THEN 'missing' ELSE 'changed' END AS problem
FROM p LEFT JOIN c USING (o_orderkey) WHERE c.o_orderkey IS NULL OR c.o_totalprice <> p.o_totalprice""")
def j5_changed_or_missing(t):
    previous, current = order_sets(t)
    return J.changed_or_missing(current, previous, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


def dependency_edges(t):
    e = t.events.where("event_id >= 1")
    return e.select(F.col("event_id").alias("claim_id"), F.floor(F.col("event_id") / 2).alias("depends_on"))


CLOSURE = """edges AS (SELECT event_id AS claim_id, event_id // 2 AS depends_on FROM events WHERE event_id >= 1),
 walk AS (SELECT event_id AS seed_id, event_id AS claim_id, 0 AS depth FROM events
   UNION ALL SELECT seed_id, depends_on, depth + 1 FROM walk JOIN edges USING (claim_id))"""


@query(f"""WITH RECURSIVE {CLOSURE} SELECT seed_id, claim_id, depth, false AS reaches_itself, false AS missing FROM walk
WHERE seed_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def j13_claim_closure(t):
    """Purchases are the selected claims."""
    nodes = t.events.select(F.col("event_id").alias("claim_id"))
    seeds = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("seed_id"))
    return J.claim_closure(dependency_edges(t), seeds, nodes)


@query(f"""WITH RECURSIVE {CLOSURE}, chosen AS (SELECT DISTINCT w.claim_id FROM walk w JOIN events e ON e.event_id = w.seed_id WHERE e.event_type = 'purchase')
SELECT e.event_id AS claim_id, u.user_id AS document_id, u.n AS document_rows FROM events e JOIN chosen ON chosen.claim_id = e.event_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u ON u.user_id = e.user_id WHERE e.event_type IN ('view', 'click')""")
def j6_supporting_evidence(t):
    closure = J.reached_claims(dependency_edges(t), t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("seed_id")))
    evidence = t.events.select(
        F.col("event_id").alias("claim_id"), F.col("user_id").alias("document_id"),
        F.when(F.col("event_type").isin("view", "click"), "support").otherwise("contrast").alias("role"),
    )
    documents = t.events.groupBy(F.col("user_id").alias("document_id")).agg(F.count("*").alias("document_rows"))
    return J.supporting_evidence(evidence, closure, documents).select("claim_id", "document_id", "document_rows")


@query("""SELECT p_partkey AS selection_id, count(l_orderkey) AS matches, CASE WHEN count(l_orderkey) = 1 THEN any_value(l_orderkey) END AS l_orderkey
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity = p_size GROUP BY p_partkey""")
def j7_match_exactly_one(t):
    left = t.part.select(F.col("p_partkey").alias("selection_id"), F.col("p_size").cast("double").alias("size"))
    right = t.lineitem.select(F.col("l_partkey").alias("selection_id"), F.col("l_quantity").alias("size"), "l_orderkey")
    return J.match_exactly_one(left, right, ["selection_id", "size"], ["l_orderkey"]).drop("size")


@query(f"""SELECT p_partkey AS id, {sq("avg(l_extendedprice / l_quantity)", 4)} AS actual_value,
  CASE WHEN p_type = 'PROMO' THEN 'basis' ELSE '' END AS mismatched FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_type""")
def j8_pair_metrics(t):
    basis = F.when(F.col("p_type") == "PROMO", "promo").otherwise("list")
    guidance = t.part.select(F.col("p_partkey").alias("id"), F.lit("usd").alias("unit"), basis.alias("basis"))
    actual = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    actual = actual.withColumn("unit", F.lit("usd")).withColumn("basis", F.lit("list"))
    out = J.pair_metrics(guidance, actual, "id", ["unit", "basis"], "value")
    return out.select("id", settle("actual_value", 4).alias("actual_value"), F.concat_ws("|", "mismatched_attributes").alias("mismatched"))


U_EXPAND = "CAST('0x' || left(md5(concat_ws(':', '11', grp, i)), 8) AS UBIGINT) / 4294967296.0"


@query(f"""WITH e AS (SELECT p_partkey AS estimate_id, CASE WHEN p_type = 'PROMO' THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS grp,
   p_retailprice * 0.9 AS a, p_retailprice AS m, p_retailprice * 1.3 AS b, unnest(range(20)) AS i FROM part),
 u AS (SELECT *, {U_EXPAND} AS u FROM e)
SELECT estimate_id, CAST(i AS INTEGER) AS draw_index, {sq('''CASE WHEN u * (b - a) < m - a THEN a + sqrt(u * (b - a) * (m - a)) ELSE b - sqrt((1 - u) * (b - a) * (b - m)) END''', 4)} AS value FROM u""")
def j10_expand_draws(t):
    p = F.col("p_retailprice")
    estimates = t.part.select(
        F.col("p_partkey").alias("estimate_id"), F.when(F.col("p_type") == "PROMO", F.col("p_brand")).alias("correlation_group"),
        (p * 0.9).alias("low"), p.alias("base"), (p * 1.3).alias("high"),
    )
    out = J.expand_draws(estimates, 20, 11)
    return out.select("estimate_id", "draw_index", settle("value", 4).alias("value"))


@query(f"""WITH s AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem),
 p AS (SELECT l_returnflag, l_extendedprice, i, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat_ws(':', '5', l_returnflag, i)), i) - 1 AS target_index FROM s)
SELECT l_returnflag, i AS draw_index, target_index, {sq("l_extendedprice", 2)} AS price FROM p""")
def j12_align_draws(t):
    from tallyforge.operators.skew import chunked_row_number

    cols = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    numbered = chunked_row_number(t.lineitem.select(*cols), ["l_returnflag"], ["l_orderkey", *ties], "_n")
    source = numbered.select("l_returnflag", "l_extendedprice", (F.col("_n") - 1).alias("draw_index"))
    out = J.align_draws(source, ["l_returnflag"], 5)
    return out.select("l_returnflag", "draw_index", "target_index", settle("l_extendedprice", 2).alias("price"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name, n_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey""")
def j14_join_dimension(t):
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    named = J.join_dimension(suppliers, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    fact = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.join_dimension(fact, named, ["l_suppkey"]).drop("n_nationkey")


@query("""SELECT p_partkey AS input_path, count(l_orderkey) AS assessments, CASE WHEN count_if(l_quantity = 50) > 0 THEN 'eligible_claim_candidate'
  WHEN count_if(l_quantity > 45) > 0 THEN 'scope_rejected_claim' WHEN count(l_orderkey) > 0 THEN 'rejected_claim' ELSE 'no_constraint_claim' END AS input_status
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'A' AND l_linestatus = 'O' GROUP BY p_partkey""")
def j15_gap_coverage(t):
    return gap_rows(t).select("input_path", "assessments", "input_status")


def gap_rows(t):
    gaps = t.part.select(F.col("p_partkey").alias("input_path"), "p_brand", F.col("p_retailprice").alias("research_priority"))
    return J.gap_coverage(gaps, assessment_rows(t))


def assessment_rows(t):
    q = F.col("l_quantity")
    scope = F.when((q > 45) & (q < 50), F.lit("dimension_mismatch:stage")).when(q <= 45, F.lit("posture_not_allowed"))
    return t.lineitem.where("l_linestatus = 'O'").select(
        F.col("l_partkey").alias("input_path"),
        F.when(F.col("l_returnflag") == "A", "constraint_input").otherwise("directional_signal").alias("usage"),
        (q == 50).alias("eligible_as_constraint"), F.array_compact(F.array(scope)).alias("blocking_codes"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, origin, {sq("sum(q)", 4)} AS capacity FROM (
  SELECT l_orderkey, l_linenumber, 'base' AS origin, l_quantity AS q FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN
     (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')
  UNION ALL SELECT l_orderkey, l_linenumber, 'linked', l_quantity * 0.5 FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL""")
def j16_replace_constraints(t):
    keys = ["l_orderkey", "l_linenumber"]
    base = t.lineitem.select(*keys, F.lit("base").alias("origin"), F.col("l_quantity").alias("capacity"))
    returned = t.lineitem.where("l_returnflag = 'R'")
    linked = returned.select(*keys, F.lit("linked").alias("origin"), (F.col("l_quantity") * 0.5).alias("capacity"))
    out = J.replace_constraints(base, returned, linked, keys)
    return settled(out.groupBy(*keys, "origin").agg(F.sum("capacity").alias("capacity")), ["capacity"])


def revision_inputs(t):
    p = F.col("p_retailprice")
    estimates = t.part.select(
        F.col("p_brand").alias("scenario_id"), F.col("p_partkey").cast("string").alias("input_path"),
        (p * 0.9).alias("low"), p.alias("base"), (p * 1.1).alias("high"),
        F.when(F.col("p_type") == "PROMO", "reported").otherwise("synthetic").alias("posture"), F.col("p_type").alias("correlation_group"),
    )
    best = t.lineitem.where("l_returnflag = 'R'").groupBy("l_partkey").agg(
        F.min("l_quantity").alias("low"), F.avg("l_quantity").alias("base"), F.max("l_quantity").alias("high")
    )
    replacements = best.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("scenario_id"), F.col("p_partkey").cast("string").alias("input_path"), "low", "base", "high",
        F.lit("derived").alias("posture"),
    )
    return estimates, replacements


REVISION = """b AS (SELECT l_partkey, min(l_quantity) AS low, avg(l_quantity) AS base, max(l_quantity) AS high FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
 e AS (SELECT p.*, b.*, p_type <> 'PROMO' AND l_partkey IS NOT NULL AS replaced FROM part p LEFT JOIN b ON l_partkey = p_partkey)"""


@query(f"""WITH {REVISION} SELECT p_brand AS scenario_id, CAST(p_partkey AS VARCHAR) AS input_path,
  {sq("CASE WHEN replaced THEN base ELSE p_retailprice END", 4)} AS base, CASE WHEN replaced THEN 'derived' WHEN p_type = 'PROMO' THEN 'reported' ELSE 'synthetic' END AS posture,
  p_type AS correlation_group, {sq("CASE WHEN replaced THEN p_retailprice END", 4)} AS previous_base, replaced FROM e""")
def j17_apply_revisions(t):
    out = J.apply_revisions(*revision_inputs(t))
    out = out.select("scenario_id", "input_path", "base", "posture", "correlation_group", "previous_base", "replaced")
    return settled(out, ["base", "previous_base"])


@query("""SELECT o_orderkey AS accession_number, 'review ' || c_mktsegment AS review_reason, o_orderkey IS NOT NULL AND o_orderstatus = 'F' AS found
FROM (SELECT c_custkey * 10 AS k, c_mktsegment FROM customer) r JOIN orders ON o_orderkey = k WHERE o_orderstatus = 'F'
UNION ALL SELECT k, 'review ' || c_mktsegment, false FROM (SELECT c_custkey * 10 AS k, c_mktsegment FROM customer) r
WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def j18_select_documents(t):
    filings = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("accession_number"))
    requests = t.customer.select((F.col("c_custkey") * 10).alias("accession_number"), F.concat(F.lit("review "), "c_mktsegment").alias("review_reason"))
    found, absent = J.select_documents(filings, requests)
    return found.withColumn("found", F.lit(True)).unionByName(absent.withColumn("found", F.lit(False)))


@query(f"""WITH x AS (SELECT s_suppkey AS id, s_name AS title, s_acctbal AS v FROM supplier
  UNION ALL SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 2000 THEN s_acctbal + 1 ELSE s_acctbal END FROM supplier
  UNION ALL SELECT 1000000 + c_custkey, c_name, c_acctbal FROM customer)
SELECT id, any_value(title) AS title, count(DISTINCT v) > 1 AS conflict FROM x GROUP BY id""")
def u1_union_evidence(t):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("v"))
    b = a.withColumn("v", F.when(F.col("v") < 2000, F.col("v") + 1).otherwise(F.col("v")))
    c = t.customer.select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("v"))
    return S.union_evidence(a, b, c).select("id", "title", "conflict")


@query("""SELECT l_partkey AS part_id, 'left_only' AS side FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50) WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)
UNION ALL SELECT l_partkey, 'right_only' FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 1) WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def u2_sets_equal(t):
    parts = t.lineitem.select(F.col("l_partkey").alias("part_id"), "l_quantity")
    return S.set_difference(parts.where("l_quantity = 50"), parts.where("l_quantity = 1"), ["part_id"])


@query("SELECT DISTINCT p_partkey AS part_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)")
def u3_uncovered(t):
    absorbed = t.lineitem.where("l_discount >= 0.1").select(F.col("l_partkey").alias("part_id"))
    return S.uncovered(t.part.select(F.col("p_partkey").alias("part_id")), absorbed, ["part_id"])


@query("""SELECT event_id, 'slow' AS type, value, NULL AS detail FROM events WHERE value > 100
UNION ALL SELECT event_id, 'failed', NULL, props FROM events WHERE event_type = 'error'""")
def u4_union_alerts(t):
    slow = t.events.where("value > 100").select("event_id", F.lit("slow").alias("type"), "value")
    failed = t.events.where("event_type = 'error'").select("event_id", F.lit("failed").alias("type"), F.col("props").alias("detail"))
    return S.union_alerts(slow, failed)


@query("SELECT user_id FROM events WHERE event_type = 'error' AND value > 60 INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60")
def u5_common_keys(t):
    big = t.events.where("value > 60")
    return S.common_keys(big.where("event_type = 'error'"), big.where("event_type = 'purchase'"), ["user_id"])


@query("""SELECT *, row_number() OVER (ORDER BY l_suppkey, n DESC, constraint_id) AS position
FROM (SELECT l_suppkey, l_linenumber AS constraint_id, count(*) AS n FROM lineitem GROUP BY ALL)""")
def t1_order_bottlenecks(t):
    counts = t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").alias("constraint_id")).agg(F.count("*").alias("probability"))
    return O.with_position(O.order_bottlenecks(counts, "l_suppkey")).withColumnRenamed("probability", "n")


@query(f"""SELECT *, row_number() OVER (ORDER BY research_priority DESC, owner, parameter) AS position
FROM (SELECT p_partkey AS parameter, p_brand AS owner, {sq("p_retailprice / 2000.0 * (1 - p_size / 100.0)")} AS research_priority FROM part)""")
def t3_order_research_queue(t):
    rows = t.part.select(
        F.col("p_partkey").alias("parameter"), F.col("p_brand").alias("owner"),
        settle(F.col("p_retailprice") / 2000.0 * (1 - F.col("p_size") / 100.0)).alias("research_priority"),
    )
    return O.with_position(O.order_research_queue(rows, ["owner"]))


@query("""WITH n AS (SELECT event_id, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'inputs.flow[' || user_id || ']' AS path, value AS base FROM n
UNION ALL SELECT event_id, 'inputs.tail', CAST(k AS DOUBLE) FROM n""")
def p3_flatten_paths(t):
    document = F.to_json(
        F.struct(
            F.struct(
                F.array(
                    F.struct(F.concat(F.lit(""), "user_id").alias("id"), F.col("value").alias("low"), F.col("value").alias("base")),
                ).alias("flow"),
                F.struct(F.col("k").alias("low"), F.col("k").alias("base")).alias("tail"),
                F.struct(F.col("k").alias("other")).alias("noise"),
            ).alias("inputs")
        )
    )
    source = spread(t.events, "event_id").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    docs = source.select("event_id", F.parse_json(document).alias("document"))
    out = P.flatten_paths(docs, ["event_id"], "document", ["low", "base"])
    return out.select("event_id", "path", F.variant_get("node", "$.base", "double").alias("base"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 's' || l_suppkey || '.' || m AS "column", {sq("v", 4)} AS value FROM
 (SELECT *, 'quantity' AS m, l_quantity AS v FROM lineitem UNION ALL SELECT *, 'price', l_extendedprice FROM lineitem)""")
def p4_flatten_draw_columns(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    owner = F.create_map(F.concat(F.lit("s"), "l_suppkey"), F.struct(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")))
    draws = t.lineitem.select(*keys, owner.alias("owners"))
    return settled(P.flatten_draw_columns(draws, keys, "owners", ["quantity", "price"]), ["value"])


@query("""SELECT o_orderkey, 'w' || c_nationkey AS watch_id FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate BETWEEN DATE '1996-01-01' + c_nationkey * 30 AND DATE '1998-01-01' AND o_orderstatus IN ('F', 'O')""")
def p6_filter_filings(t):
    filings = t.orders.select("o_orderkey", F.col("o_custkey").alias("entity_id"), F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderstatus").alias("form"))
    watches = t.customer.select(
        F.concat(F.lit("w"), "c_nationkey").alias("id"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("c_nationkey") * 30).alias("filing_date_from"),
        F.lit("1998-01-01").cast("date").alias("filing_date_to"), F.array(F.lit("F"), F.lit("O")).alias("forms"), F.array("c_custkey").alias("entities"),
    )
    return P.filter_filings(filings, watches).select("o_orderkey", "watch_id")


@query("""SELECT o_orderkey, o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-04-01' AND
  CASE WHEN o_orderstatus = 'O' THEN o_orderpriority <> '1-URGENT' ELSE o_orderpriority = '1-URGENT' AND o_orderdate + INTERVAL 30 DAY < DATE '1999-04-01' END AS inside
FROM orders""")
def p8_in_capacity_window(t):
    target = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_add(F.to_date("o_orderdate"), 30))
    stage = F.when(F.col("o_orderstatus") == "O", "operational").otherwise("contracted")
    end = D.quarter_end_exclusive(F.lit("1999-Q1"))
    inside = P.in_capacity_window(F.to_date("o_orderdate"), target, stage, F.lit("1996-01-01").cast("date"), end)
    return t.orders.select("o_orderkey", inside.alias("inside"))


@query("""SELECT p_partkey, c AS "case", b AS bound, a AS adverse_bound, q AS quantile FROM part,
 (VALUES ('bear', 'low', 'high', 'p10'), ('base', 'base', 'base', 'p50'), ('bull', 'high', 'low', 'p90')) AS v(c, b, a, q)""")
def p15_named_case_inputs(t):
    return P.named_cases(t.part.select("p_partkey"))


@query(f"""WITH s AS (SELECT l_suppkey, {six_sql("l_quantity")} FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, p10 AS low, p50 AS base, p90 AS high, CASE WHEN s_acctbal < 0 THEN 'synthetic' ELSE 'modeled' END AS posture,
 'linked:supplier:' || left(sha256(s_name), 12) || ':quantity' AS correlation_group FROM s JOIN supplier ON s_suppkey = l_suppkey""")
def p17_distribution_to_estimate(t):
    rows = settled(A.summarize(t.lineitem, ["l_suppkey"], "l_quantity")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(
        "l_suppkey", "p10", "p50", "p90", (F.col("s_acctbal") < 0).alias("source_synthetic"), F.lit("supplier").alias("source"),
        F.sha2("s_name", 256).alias("source_digest"), F.lit("quantity").alias("metric"),
    )
    return P.distribution_to_estimate(rows).select("l_suppkey", "low", "base", "high", "posture", "correlation_group")


@query("SELECT p_partkey, 1.0::DOUBLE AS low, 1.0::DOUBLE AS base, 1.0::DOUBLE AS high, 'derived' AS posture FROM part")
def p18_identity_estimate(t):
    return P.identity_estimate(t.part.select("p_partkey")).drop("correlation_group")


@query("""SELECT p_partkey, 'manufacturing' AS stage, p_brand AS constraint_id, p_size / 50.0 AS probability FROM part
UNION ALL SELECT p_partkey, 'shipped', p_type, 1 - p_size / 50.0 FROM part""")
def p19_bottlenecks_long(t):
    p = F.col("p_size") / 50.0
    flat = t.part.select("p_partkey", F.array(F.struct(F.col("p_brand").alias("constraint"), p.alias("probability"))).alias("bottlenecks"))
    staged = t.part.select(
        "p_partkey", F.array(F.struct(F.lit("shipped").alias("stage"), F.col("p_type").alias("resource_id"), (1 - p).alias("probability"))).alias("bottlenecks")
    )
    first = P.bottlenecks_long(flat, ["p_partkey"], default_stage="manufacturing")
    return first.unionByName(P.bottlenecks_long(staged, ["p_partkey"]))


@query("SELECT o_orderkey AS claim_key, 'c' || o_custkey AS snapshot_id, c_name AS publisher, 'primary' AS role FROM orders JOIN customer ON c_custkey = o_custkey")
def p20_evidence_from_claims(t):
    edge = F.struct(F.concat(F.lit("c"), "o_custkey").alias("snapshot_id"), F.lit("primary").alias("role"))
    claims = t.orders.select(F.col("o_orderkey").alias("claim_key"), F.array(edge).alias("evidence"))
    metadata = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("snapshot_id"), F.col("c_name").alias("publisher"))
    return P.evidence_from_claims(claims, metadata)


@query("SELECT p_partkey, p_brand || '|' || p_type AS ids, p_retailprice AS value FROM part")
def p21_flatten_scores(t):
    nested = t.part.select("p_partkey", F.struct(F.array("p_brand", "p_type").alias("ids"), F.col("p_retailprice").alias("value")).alias("score"))
    return P.flatten_scores(nested, "score", ["ids"])


@query("""WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
SELECT doc_id, i - 1 AS pos, length(parts[i]) AS characters, sha256(parts[i]) AS line_sha FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM w)""")
def s4_columns_to_rows(t):
    from tallyforge.sources.readers import columns_to_rows

    lines = F.split("text", "\n", -1)
    source = t.documents.select(
        "doc_id", F.transform(lines, lambda x, i: i.cast("bigint")).alias("pos"),
        F.transform(lines, lambda x: F.char_length(x).cast("bigint")).alias("characters"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("line_sha"),
    )
    rows, _ = columns_to_rows(source, ["doc_id"], ["pos", "characters", "line_sha"])
    return rows
