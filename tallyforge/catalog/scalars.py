"""Column functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import dates as D
from tallyforge.functions import maths as M
from tallyforge.functions import text as X
from tallyforge.functions import values as V

from . import query, sq

U = "CAST('0x' || left(md5(concat_ws(':', '7', {key}, {index})), 8) AS UBIGINT) / 4294967296.0"
U_PART = U.format(key="p_brand", index="p_partkey")


def uniform_part():
    return M.keyed_uniform(7, "p_brand", "p_partkey")


@query(f"SELECT p_partkey, {sq(U_PART)} AS u FROM part")
def st10_keyed_uniform(t):
    return t.part.select("p_partkey", M.settle(uniform_part()).alias("u"))


TRI = """CASE WHEN u * (b - a) < m - a THEN a + sqrt(u * (b - a) * (m - a))
     ELSE b - sqrt((1 - u) * (b - a) * (b - m)) END"""


@query(f"""WITH e AS (SELECT p_partkey, {U_PART} AS u, p_retailprice * 0.9 AS a, p_retailprice AS m,
             p_retailprice * (1 + p_size / 100.0) AS b FROM part)
SELECT p_partkey, {sq(TRI, 4)} AS sampled FROM e""")
def ma1_triangular_inverse(t):
    p = F.col("p_retailprice")
    v = M.triangular_inverse(uniform_part(), p * 0.9, p, p * (1 + F.col("p_size") / 100.0))
    return t.part.select("p_partkey", M.settle(v, 4).alias("sampled"))


CDF = """CASE WHEN a = b THEN CASE WHEN x < a THEN 0.0 ELSE 1.0 END WHEN x <= a THEN 0.0 WHEN x >= b THEN 1.0
  WHEN x <= m THEN CASE WHEN m = a THEN 0.0 ELSE (x - a) * (x - a) / ((b - a) * (m - a)) END
  ELSE CASE WHEN m = b THEN 1.0 ELSE 1 - (b - x) * (b - x) / ((b - a) * (b - m)) END END"""


@query(f"""WITH e AS (SELECT p_partkey, p_retailprice * 0.9 AS a, p_retailprice AS m, p_retailprice * 1.2 AS b,
             p_retailprice * (0.85 + p_size / 100.0) AS x FROM part)
SELECT p_partkey, {sq(CDF)} AS cdf FROM e""")
def ma2_triangular_cdf(t):
    p = F.col("p_retailprice")
    v = M.triangular_cdf(p * 0.9, p, p * 1.2, p * (F.col("p_size") / 100.0 + 0.85))
    return t.part.select("p_partkey", M.settle(v).alias("cdf"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  {sq("CASE WHEN l_quantity >= 25 THEN 0.1 * (l_quantity - 25) ELSE 0.9 * (25 - l_quantity) END")} AS loss
FROM lineitem""")
def ma3_pinball(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        M.settle(M.pinball(F.lit(25.0), "l_quantity", 0.1)).alias("loss"),
    )


EVENT = CDF.replace("x", "threshold")


@query(f"""WITH e AS (SELECT p_partkey, p_retailprice * 0.9 AS a, p_retailprice AS m, p_retailprice * 1.2 AS b,
    p_retailprice * (0.85 + p_size / 100.0) AS threshold, p_retailprice * 1.05 AS actual,
    CASE WHEN p_size > 25 THEN 'at_least' ELSE 'at_most' END AS op FROM part),
  f AS (SELECT *, CASE WHEN op = 'at_least' THEN 1 - ({EVENT}) ELSE {EVENT} END AS prob,
    CASE WHEN op = 'at_least' THEN actual >= threshold ELSE actual <= threshold END AS realized FROM e)
SELECT p_partkey, op, realized, {sq("prob")} AS probability,
  {sq("(prob - CASE WHEN realized THEN 1 ELSE 0 END) * (prob - CASE WHEN realized THEN 1 ELSE 0 END)")} AS brier FROM f""")
def ma4_brier(t):
    p = F.col("p_retailprice")
    e = t.part.select(
        "p_partkey", (p * 0.9).alias("a"), p.alias("m"), (p * 1.2).alias("b"),
        (p * (F.col("p_size") / 100.0 + 0.85)).alias("threshold"), (p * 1.05).alias("actual"),
        F.when(F.col("p_size") > 25, "at_least").otherwise("at_most").alias("op"),
    )
    e = e.withColumn("probability", M.triangular_event_probability("a", "m", "b", "op", "threshold"))
    e = e.withColumn("realized", M.event_realized("op", "threshold", "actual"))
    return e.select(
        "p_partkey", "op", "realized", M.settle("probability").alias("probability"),
        M.settle(M.brier("probability", "realized")).alias("brier"),
    )


DIES = "greatest(pi() * (300 - 6) * (300 - 6) / 4 / {a} - pi() * (300 - 6) / sqrt(2 * {a}), 0.0)".format(
    a="((5 + p_size + 0.1) * (6 + p_size / 2.0 + 0.1))"
)


@query(f"SELECT p_partkey, {sq(DIES)} AS dies FROM part")
def ma5_gross_dies(t):
    s = F.col("p_size")
    v = M.gross_dies_per_wafer(F.lit(300.0), F.lit(3.0), s + 5, s / 2.0 + 6, F.lit(0.1))
    return t.part.select("p_partkey", M.settle(v).alias("dies"))


@query(f"""SELECT p_partkey, {sq("pow(1 + p_retailprice / 20000.0 * ((5 + p_size) * 10 / 100.0) / 2.5, -2.5)")} AS die_yield
FROM part""")
def ma6_die_yield(t):
    v = M.negative_binomial_yield(F.col("p_retailprice") / 20000.0, (F.col("p_size") + 5) * 10, F.lit(2.5))
    return t.part.select("p_partkey", M.settle(v).alias("die_yield"))


@query(f"""SELECT o_orderkey,
  {sq("CASE WHEN c_acctbal = 0 THEN 0.0 ELSE o_totalprice / c_acctbal END")} AS ratio,
  {sq("CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / CASE WHEN o_orderstatus = 'P' THEN 2.0 ELSE 4.0 END END")} AS null_ratio
FROM orders JOIN customer ON o_custkey = c_custkey""")
def ma7_safe_ratio(t):
    divisor = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "P", 2.0).otherwise(4.0)
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "o_orderkey", M.settle(M.safe_ratio("o_totalprice", "c_acctbal")).alias("ratio"),
        M.settle(M.safe_ratio("o_totalprice", divisor, None)).alias("null_ratio"),
    )


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 0.0 ELSE value END AS p,
    CASE WHEN event_type IN ('click', 'error') THEN 0.0 ELSE value * 1.5 END AS c FROM events)
SELECT event_id, {sq("CASE WHEN abs(p) <= 1e-12 THEN CASE WHEN abs(c) <= 1e-12 THEN 0.0 END ELSE (c - p) / abs(p) END")} AS change
FROM e""")
def ma8_relative_change(t):
    p = F.when(F.col("event_type").isin("click", "view"), 0.0).otherwise(F.col("value"))
    c = F.when(F.col("event_type").isin("click", "error"), 0.0).otherwise(F.col("value") * 1.5)
    return t.events.select("event_id", M.settle(M.relative_change(p, c)).alias("change"))


@query(f"""SELECT event_id, {sq("greatest(20.0 - value, value - 80.0, 0.0)")} AS miss,
  {sq("greatest((value * 1.001 - value * 0.999) / 2, abs(value) * 0.01, 1e-12)")} AS scale,
  CASE WHEN value BETWEEN 20 AND 80 THEN 'inside_range' WHEN value > 80 THEN 'above_range' ELSE 'below_range' END AS direction
FROM events""")
def ma9_ma10_p13_range_scores(t):
    v = F.col("value")
    return t.events.select(
        "event_id", M.settle(M.interval_miss(F.lit(20.0), F.lit(80.0), v)).alias("miss"),
        M.settle(M.half_width_scale(v * 0.999, v, v * 1.001)).alias("scale"),
        M.range_position(F.lit(20.0), F.lit(80.0), v).alias("direction"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  abs(l_quantity * 2000 - l_extendedprice) <= greatest(0.05 * greatest(abs(l_quantity * 2000), abs(l_extendedprice)), 10.0) AS tied
FROM lineitem""")
def p9_is_close(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        M.is_close(F.col("l_quantity") * 2000, "l_extendedprice", 0.05, 10.0).alias("tied"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  {sq("l_quantity * (1 - l_discount) * 0.5 / (1 + l_tax)")} AS equivalents FROM lineitem""")
def p1_system_equivalents(t):
    v = M.system_equivalents("l_quantity", 1 - F.col("l_discount"), F.lit(0.5), F.col("l_tax") + 1)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", M.settle(v).alias("equivalents")
    )


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || quarter(o_orderdate) AS quarter,
  strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS first_day,
  strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH, '%Y-%m-%d') AS exclusive_end,
  strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day
FROM orders""")
def dt1_quarter_bounds(t):
    q = t.orders.select("o_orderkey", D.quarter_of("o_orderdate").alias("quarter"))
    return q.select(
        "o_orderkey", "quarter", D.quarter_start("quarter").cast("string").alias("first_day"),
        D.quarter_end_exclusive("quarter").cast("string").alias("exclusive_end"),
        D.quarter_end("quarter").cast("string").alias("last_day"),
    )


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN NULL
  ELSE strftime(date_trunc('second', ts) - CASE WHEN event_type = 'click' THEN INTERVAL 150 MINUTE ELSE INTERVAL 0 MINUTE END,
       '%Y-%m-%d %H:%M:%S') END AS utc FROM events""")
def dt2_to_utc(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_type") == "click", "+02:30").when(F.col("event_type") == "view", "").otherwise("Z")
    return t.events.select(
        "event_id", F.date_format(D.to_utc(F.concat(stamp, zone)), "yyyy-MM-dd HH:mm:ss").alias("utc")
    )


@query("""SELECT o_orderkey, CASE WHEN DATE '1999-01-01' <= q THEN 'pending_period_end'
   WHEN DATE '1999-01-01' < q + INTERVAL 30 DAY THEN 'pending_observation_window'
   WHEN DATE '1999-01-01' <= q + INTERVAL 90 DAY THEN 'awaiting_outcome' ELSE 'outcome_overdue' END AS status
FROM (SELECT o_orderkey, date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS q FROM orders)""")
def p12_maturity_status(t):
    cutoff = D.quarter_end(D.quarter_of("o_orderdate"))
    status = D.maturity_status(F.lit("1999-01-01").cast("date"), cutoff, F.date_add(cutoff, 30), F.date_add(cutoff, 90))
    return t.orders.select("o_orderkey", status.alias("status"))


@query("""SELECT event_id, 'event:' || left(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 16) AS id
FROM events""")
def st1_content_id(t):
    return t.events.select(
        "event_id", V.content_id("event:", 16, user_id="user_id", event_type="event_type").alias("id")
    )


ACCESSION_SQL = """printf('%010d-%02d-%06d', o_custkey, year(o_orderdate) % 100, o_orderkey)"""
ACCESSION_FORM = r"\d{10}-\d{2}-\d{6}"
ACCESSION_OK = f"regexp_full_match({ACCESSION_SQL}, '{ACCESSION_FORM}')"  # a key of more digits than its field has another form


def accession(order_key="o_orderkey", customer="o_custkey", day="o_orderdate"):
    return F.format_string(
        "%010d-%02d-%06d", F.col(customer), F.year(day) % 100, F.col(order_key)
    )


@query(f"""SELECT o_orderkey, {ACCESSION_OK} AS accession_ok, o_orderstatus <> 'F' AS quarter_ok,
  regexp_full_match(lower(o_orderpriority), '[a-z0-9]+(-[a-z0-9]+)*') AS slug_ok,
  true AS sha_ok FROM orders""")
def st2_matches_id(t):
    quarter = F.when(F.col("o_orderstatus") == "F", "1999-Q5").otherwise(D.quarter_of("o_orderdate"))
    return t.orders.select(
        "o_orderkey", X.matches_id(accession(), "accession").alias("accession_ok"),
        X.matches_id(quarter, "quarter").alias("quarter_ok"),
        X.matches_id(F.lower("o_orderpriority"), "slug").alias("slug_ok"),
        X.matches_id(F.sha2("o_orderstatus", 256), "sha256").alias("sha_ok"),
    )


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_sha,
  length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS characters FROM documents""")
def st3_normalize_ws(t):
    text = X.normalize_ws("text")
    return t.documents.select(
        "doc_id", F.sha2(text, 256).alias("text_sha"), F.char_length(text).cast("bigint").alias("characters")
    )


@query("""SELECT doc_id, part, substring(text, greatest(s - 10, 0) + 1, least(least(s + 20, n) + 10, n) - greatest(s - 10, 0)) AS around
FROM (SELECT doc_id, text, length(text) AS n, unnest([0, length(text) // 2, length(text)]) AS s, unnest(['first', 'middle', 'last']) AS part FROM documents)""")
def st4_snippet(t):
    """Spans at the start, in the middle and at the end of every text."""
    n = F.char_length("text")
    spans = F.array(*[F.struct(F.lit(name).alias("part"), at.cast("int").alias("s")) for name, at in (("first", F.lit(0)), ("middle", F.floor(n / 2)), ("last", n))])
    placed = t.documents.select("doc_id", "text", F.inline(spans))
    return placed.select("doc_id", "part", X.snippet("text", F.col("s"), F.least(F.col("s") + 20, n), 10).alias("around"))


@query(f"""SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/'
  || replace({ACCESSION_SQL}, '-', '') || '/form-' || o_orderstatus || '.htm' AS url FROM orders""")
def st5_filing_url(t):
    cik = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    return t.orders.select(
        "o_orderkey",
        X.filing_url(cik, accession(), F.concat(F.lit("form-"), F.col("o_orderstatus"), F.lit(".htm"))).alias("url"),
    )


@query("""WITH p AS (SELECT doc_id, string_split(lower(text), 'tion') AS parts FROM documents),
  e AS (SELECT doc_id, unnest(parts[1:len(parts) - 1]) AS piece, unnest(range(1, len(parts))) AS occurrence FROM p)
SELECT doc_id, CAST(occurrence AS INTEGER) AS occurrence,
  CAST(sum(length(piece) + 4) OVER (PARTITION BY doc_id ORDER BY occurrence) - 4 AS INTEGER) AS character_start,
  CAST(sum(length(piece) + 4) OVER (PARTITION BY doc_id ORDER BY occurrence) AS INTEGER) AS character_end FROM e""")
def st6_literal_positions(t):
    return t.documents.select("doc_id", F.inline(X.literal_spans("text", F.lit("TION"))))


@query("""SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS joined, 3 AS id_count FROM part""")
def st7_join_split_ids(t):
    joined = X.join_ids(F.array("p_brand", "p_type", "p_name"))
    return t.part.select("p_partkey", joined.alias("joined"), F.size(X.split_ids(F.concat(joined, F.lit("||")))).alias("id_count"))


@query("""SELECT doc_id, substring(text, s + 1, 20) = CASE WHEN doc_id % 2 = 0 THEN substring(text, s + 1, 20) ELSE coalesce(substring(other, s + 1, 20), '') END AS anchored
FROM (SELECT d.doc_id, d.text, n.text AS other, d.doc_id * 37 % greatest(length(d.text), 1) AS s FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1)""")
def st8_anchor_matches(t):
    """Spans that start anywhere in a text, held against the text itself or the next one."""
    other = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    joined = t.documents.select("doc_id", "text").join(other, "doc_id", "left")
    joined = joined.withColumn("s", (F.col("doc_id") * 37 % F.greatest(F.char_length("text"), F.lit(1))).cast("int"))
    held = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("other"))
    expected = F.coalesce(F.substring(held, F.col("s") + 1, F.lit(20)), F.lit(""))
    return joined.select("doc_id", X.anchor_matches("text", F.col("s"), F.col("s") + 20, expected).alias("anchored"))


@query("""SELECT page_id, CASE WHEN url LIKE '%com%' THEN 'text/html' WHEN url LIKE '%net%' THEN 'application/pdf'
  ELSE 'application/octet-stream' END AS media_type FROM pages""")
def st9_media_type(t):
    name = (
        F.when(F.col("url").contains("com"), "a.HTM").when(F.col("url").contains("net"), "b.pdf").otherwise("c.bin")
    )
    return t.pages.select("page_id", X.media_type(name).alias("media_type"))


@query("""SELECT page_id, CASE WHEN lower(url) LIKE '%nist%' OR lower(url) LIKE '%.gov%' OR lower(url) LIKE '%government%'
   THEN 'government_record' ELSE 'other' END AS kind,
  CASE WHEN url LIKE 'https%' THEN 'third_party_research' ELSE 'other' END AS source_kind FROM pages""")
def p16_evidence_kind(t):
    source = F.when(F.col("url").startswith("https"), "third_party_dataset").otherwise("blog")
    return t.pages.select(
        "page_id", X.evidence_kind_from_text(F.lit("web"), F.lit("Site"), "url").alias("kind"),
        X.evidence_kind_from_source(source).alias("source_kind"),
    )


@query("""SELECT p_partkey, p_brand < p_type AS sorted_unique FROM part""")
def ar1_sorted_unique(t):
    return t.part.select("p_partkey", V.is_sorted_unique(F.array("p_brand", "p_type")).alias("sorted_unique"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'missing:stage' WHEN 'view' THEN 'blank:stage' WHEN 'error' THEN 'unknown:colour'
  ELSE '' END AS errors FROM events""")
def mp1_dimension_map(t):
    base = [
        "entity_scope", "site", "geography", "global", "period", "2024-Q1", "capacity_basis", "sellable_output",
        "quantity_semantics", "quarter_total",
    ]
    pairs = [F.lit(x) for x in base]
    full = F.create_map(*pairs, F.lit("stage"), F.lit("shipped"))
    dims = (
        F.when(F.col("event_type") == "click", F.create_map(*pairs))
        .when(F.col("event_type") == "view", F.create_map(*pairs, F.lit("stage"), F.lit(" ")))
        .when(F.col("event_type") == "error", F.map_concat(full, F.create_map(F.lit("colour"), F.lit("red"))))
        .otherwise(full)
    )
    return t.events.select(
        "event_id",
        F.concat_ws("|", V.dimension_map_errors(dims, V.CORE_DIMENSIONS, V.OPTIONAL_DIMENSIONS)).alias("errors"),
    )


CLAIM_JSON_SQL = """CASE event_type WHEN 'click' THEN CAST(value AS VARCHAR)
   WHEN 'view' THEN '{"low": ' || value || ', "base": ' || value * 2 || ', "high": ' || value * 3 || '}'
   WHEN 'error' THEN '{"low": ' || value || ', "high": ' || value * 3 || '}'
   WHEN 'signup' THEN '"many"'
   ELSE '{"low": ' || value * 2 || ', "base": ' || value || ', "high": ' || value || '}' END"""


# The verdict on the range that ``claim_json`` writes: (v, 2v, 3v) for a view and (2v, v, v) for a purchase.
RANGE_SQL = """CASE WHEN event_type = 'signup' OR value IS NULL THEN 'value_is_not_numeric_capacity' WHEN event_type = 'click' THEN '' WHEN event_type = 'error' THEN 'range_has_no_base'
   WHEN event_type = 'view' AND value <= value * 2 AND value * 2 <= value * 3 OR event_type = 'purchase' AND value * 2 <= value THEN '' ELSE 'range_is_not_ordered' END"""


def claim_json():
    v = F.col("value")
    text = lambda x: x.cast("string")
    return (
        F.when(F.col("event_type") == "click", text(v))
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit('{"low": '), text(v), F.lit(', "base": '), text(v * 2), F.lit(', "high": '), text(v * 3), F.lit("}")),
        )
        .when(F.col("event_type") == "error", F.concat(F.lit('{"low": '), text(v), F.lit(', "high": '), text(v * 3), F.lit("}")))
        .when(F.col("event_type") == "signup", F.lit('"many"'))
        .otherwise(
            F.concat(F.lit('{"low": '), text(v * 2), F.lit(', "base": '), text(v), F.lit(', "high": '), text(v), F.lit("}"))
        )
    )


@query(f"""WITH r AS (SELECT *, {RANGE_SQL} AS blocker FROM events)
SELECT event_id, {sq("CASE WHEN blocker = '' THEN CASE event_type WHEN 'purchase' THEN value * 2 ELSE value END END * 2.5", 4)} AS low,
  {sq("CASE WHEN blocker = '' THEN CASE event_type WHEN 'view' THEN value * 3 ELSE value END END * 2.5", 4)} AS high, blocker, 'derived' AS posture FROM r""")
def p10_normalize_range(t):
    r = t.events.select("event_id", V.normalized_range(claim_json(), F.lit(2.5)).alias("r"))
    return r.select(
        "event_id", M.settle("r.low", 4).alias("low"), M.settle("r.high", 4).alias("high"),
        F.coalesce("r.blocker", F.lit("")).alias("blocker"),
        V.normalized_posture(F.lit("reported"), F.lit(2.5)).alias("posture"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN event_type IN ('click') THEN 'number' WHEN event_type = 'signup' THEN 'text' ELSE 'object' END AS kind FROM events""")
def js1_json_value(t):
    return t.events.select(
        "event_id", V.json_number("props", "$.k").alias("k"), V.json_kind(claim_json()).alias("kind")
    )


@query("""SELECT p_partkey, concat_ws('|', CASE WHEN p_brand <> 'Brand#1' THEN 'dimension_mismatch:brand' END,
  CASE WHEN p_size <> 10 THEN 'dimension_mismatch:size' END, CASE WHEN p_type <> 'PROMO' THEN 'dimension_mismatch:type' END) AS codes
FROM part""")
def p11_dimension_mismatches(t):
    claim = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    target = F.create_map(*[F.lit(x) for x in ("brand", "Brand#1", "type", "PROMO", "size", "10")])
    return t.part.select("p_partkey", F.concat_ws("|", V.dimension_mismatches(claim, target)).alias("codes"))


@query(f"""SELECT event_id, CASE WHEN {RANGE_SQL} <> '' THEN 'rejected'
  WHEN event_type = 'click' THEN 'constraint_eligible' ELSE 'scale_control' END AS status FROM events""")
def p14_assessment_status(t):
    r = t.events.select(
        "event_id", V.normalized_range(claim_json(), F.lit(1.0)).alias("r"),
        F.when(F.col("event_type") == "click", "constraint_input").otherwise("scale_control").alias("usage"),
    )
    accepted = F.col("r.blocker").isNull()
    return r.select(
        "event_id", V.assessment_status(accepted, accepted & (F.col("usage") == "constraint_input"), "usage").alias("status")
    )


@query("""SELECT p_partkey, p_name LIKE '%widget%' AND p_brand <> 'Brand#3' AS selected FROM part""")
def p7_match_required_tokens(t):
    users = F.concat_ws(" , ", F.split("p_name", " "))
    return t.part.select(
        "p_partkey", (V.has_tokens(users, F.array(F.lit("widget"))) & (F.col("p_brand") != "Brand#3")).alias("selected")
    )
