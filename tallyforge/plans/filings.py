"""Disclosure ingestion: filings, captured documents, term hits, anchored claims, capacity imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import quarter_end_exclusive, quarter_start
from tallyforge.functions.text import anchor_matches, evidence_kind_from_text, filing_url, literal_pieces, matches_id, media_type, snippet, spans_of_pieces
from tallyforge.functions.values import content_id, has_tokens, is_sorted_unique
from tallyforge.operators.aggregates import document_term_counts, sum_ranges
from tallyforge.operators.joins import changed_or_missing, closure_per_selection, cyclic_claims, match_exactly_one, new_rows, select_documents, supporting_evidence
from tallyforge.operators.ordering import order_filings
from tallyforge.operators.projections import filter_filings, in_capacity_window
from tallyforge.operators.sets import union_evidence
from tallyforge.operators.skew import union_all
from tallyforge.operators.windows import cap_hits
from tallyforge.session import stored
from tallyforge.sources.readers import columns_to_rows

# Size limits in bytes.
MAX_SOURCE_BYTES = 25_000_000
MAX_DOCUMENT_BYTES = 100_000_000


def normalize_filings(sources: DataFrame, watches: DataFrame, columns: list[str]) -> DataFrame:
    """Column-array sources → filing rows inside each watch's window and forms, in feed order.

    ``sources(entity_id, cik, company_name, <columns…>)`` where the columns are parallel arrays that
    include accession_number, filing_date, acceptance_datetime, form and primary_document.
    """
    rows, _ = columns_to_rows(sources, ["entity_id", "cik", "company_name"], columns)
    valid = rows.where(matches_id("accession_number", "accession"))
    linked = valid.withColumn("filing_url", filing_url("cik", "accession_number", "primary_document"))
    return order_filings(filter_filings(linked, watches))


def rejected_filings(sources: DataFrame, columns: list[str]) -> DataFrame:
    """Violations: sources whose parallel arrays differ in length, and filings whose accession number has another form."""
    rows, uneven = columns_to_rows(sources, ["entity_id", "cik", "company_name"], columns)
    bad = rows.where(~F.coalesce(matches_id("accession_number", "accession"), F.lit(False)))
    shape = lambda df, key, detail: df.select(F.lit("CO23").alias("check_id"), F.lit("filings").alias("table"), F.col(key).cast("string").alias("key"), F.lit(detail).alias("detail"))
    return shape(uneven, "entity_id", "array_lengths_differ").unionByName(shape(bad, "accession_number", "invalid_accession"))


def filing_delta(current: DataFrame, previous: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """New filings, and earlier ones that vanished or changed (violations)."""
    key = "accession_number"
    return new_rows(current, previous, key), changed_or_missing(current, previous, key, fields)


def filing_claims(filings: DataFrame) -> DataFrame:
    """One asserted disclosure-event claim per filing."""
    compact = F.replace(F.col("accession_number"), F.lit("-"), F.lit(""))
    return filings.select(
        F.concat(F.lit("company."), F.col("entity_id").cast("string"), F.lit(".sec_filing."), compact).alias("claim_key"),
        F.col("company_name").alias("subject"),
        F.to_json(F.struct("accession_number", "form", "filing_date", "primary_document", "filing_url")).alias("value_json"),
        F.lit("filing_event").alias("unit"), F.lit("reported").alias("posture"), F.lit("asserted").alias("status"),
        F.col("filing_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(0.99).alias("confidence"),
    )


def capture_documents(filings: DataFrame, requests: DataFrame, files: DataFrame, limit: int = MAX_DOCUMENT_BYTES, least: int = 1) -> DataFrame:
    """Requested documents with their file facts and a problem code.

    ``requests(accession_number, review_reason, expected_sha256)``; ``files(accession_number, name,
    bytes, sha256)``. Files of fewer bytes than ``least`` are empty, those of more than ``limit`` too large.
    """
    found, absent = select_documents(filings, requests)
    joined = found.join(files, "accession_number", "left")
    problem = (
        F.when(F.col("sha256").isNull(), "file_missing")
        .when(F.col("bytes") < least, "file_empty")
        .when(F.col("bytes") > limit, "file_too_large")
        .when(F.col("expected_sha256").isNotNull() & (F.col("expected_sha256") != F.col("sha256")), "hash_mismatch")
    )
    rows = joined.select("accession_number", "review_reason", "name", "bytes", "sha256", media_type("name").alias("media_type"), problem.alias("problem"))
    unknown = absent.select("accession_number", "review_reason", F.lit("unknown_filing").alias("problem"))
    return rows.unionByName(unknown, allowMissingColumns=True)


def term_matches(documents: DataFrame, document: str, text: str, terms: list[dict]) -> DataFrame:
    """Every (document, term) with its whole text split at the matches; terms are a short recipe carried as literals."""
    listed = F.array(*[F.struct(*[F.lit(t[k]).alias(k) for k in ("term_id", "category", "literal")]) for t in terms])
    pairs = documents.select(document, F.col(text).alias("_text"), F.explode(listed).alias("_t"))
    return pairs.select(document, "_text", "_t.*", literal_pieces("_text", F.col("_t.literal")).alias("_pieces"))


def index_terms(documents: DataFrame, document: str, text: str, terms: list[dict], context: int, limit: int) -> dict[str, DataFrame]:
    """Literal hits with offsets and snippets (the first ``limit`` per term and document), and counts.

    The limit bounds what is recorded; every match of the whole text is counted.
    """
    matches = term_matches(documents, document, text, terms)
    spans = spans_of_pieces("_pieces", F.col("literal"), limit)
    hits = matches.select(document, "_text", "term_id", "category", "literal", F.inline(spans))
    kept = cap_hits(hits, limit).withColumn("snippet", snippet("_text", "character_start", "character_end", context)).drop("_text")
    found = F.size("_pieces") - 1
    counts = matches.select(
        document, "term_id", F.least(found, F.lit(limit)).cast("bigint").alias("hit_count"),
        F.greatest(found - limit, F.lit(0)).cast("bigint").alias("truncated_hit_count"),
    )
    sizes = documents.select(
        document, F.char_length(text).cast("bigint").alias("character_count"),
        F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("bigint").alias("word_count"),
    )
    return {"hits": kept, "documents": document_term_counts(counts, document).join(sizes, document)}


def anchor_claims(texts: DataFrame, specs: DataFrame, recorded_at: Column) -> tuple[DataFrame, DataFrame]:
    """Claims whose reviewed span equals the text, and the anchors that fail.

    ``texts(accession_number, text, retrieved_at)``; ``specs(spec_id, accession_number,
    character_start, character_end, expected_text)``. The judged anchors are written once: claims and failures are read from them, not from the texts.
    """
    joined = specs.join(texts, "accession_number", "left")
    problem = (
        F.when(F.col("text").isNull(), "document_absent")
        .when(F.col("character_end") > F.char_length("text"), "anchor_exceeds_document")
        .when(~anchor_matches("text", "character_start", "character_end", "expected_text"), "anchor_mismatch")
        .when(recorded_at < F.col("retrieved_at"), "recorded_before_retrieval")
    )
    judged = stored(joined.withColumn("problem", problem).drop("text"), "anchors")
    source = F.concat(F.lit("sec-filing-"), F.replace(F.col("accession_number").cast("string"), F.lit("-"), F.lit("")))
    anchored = judged.where("problem IS NULL").withColumn("source_id", source)
    claims = anchored.withColumn(
        "claim_id", content_id("claim:", 16, accession="accession_number", start="character_start", end="character_end", text="expected_text")
    )
    return claims.drop("problem"), judged.where("problem IS NOT NULL").select("spec_id", "problem")


#: What every filing's evidence row states.
FILING_PUBLISHER, FILING_LICENSE = "U.S. Securities and Exchange Commission", "SEC website terms"


def anchored_evidence(claims: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence rows of the filings that anchored claims rest on (one each), the edges to them, and the filings that cannot serve.

    ``claims`` come from ``anchor_claims``; ``documents(accession_number, media_type, source_url, filing_date, retrieved_at, content_sha256,
    source_sha256)``, the last being the digest of the raw file at hand. Problems ``(accession_number, problem)``; the claims of such a filing get no edges.
    """
    used = claims.select("accession_number", "source_id").distinct()
    copies = documents.groupBy("accession_number").agg(F.count("*").alias("copies"), F.first(F.struct(*[c for c in documents.columns if c != "accession_number"])).alias("_d"))
    problem = (
        F.when(F.col("copies").isNull(), "document_absent").when(F.col("copies") > 1, "document_not_unique")
        .when(~F.col("_d.content_sha256").eqNullSafe(F.col("_d.source_sha256")) | F.col("_d.content_sha256").isNull(), "source_hash_mismatch")
    )
    judged = stored(used.join(copies, "accession_number", "left").withColumn("problem", problem), "filings")  # all three outputs read it
    rows = judged.where("problem IS NULL").select(
        F.col("source_id").alias("id"), F.lit("raw_source").alias("capture_kind"), "_d.media_type", "_d.source_url", F.lit(FILING_PUBLISHER).alias("publisher"),
        F.concat(F.lit("sec-edgar-filing-"), F.col("accession_number").cast("string")).alias("source_family"), F.col("_d.filing_date").alias("published_at"), "_d.retrieved_at",
        F.lit(FILING_LICENSE).alias("license"), F.col("_d.content_sha256").alias("content_hash"),
    )
    edges = claims.select("claim_id", F.col("source_id").alias("id"), F.lit("support").alias("role")).join(rows.select("id"), "id", "left_semi")
    return rows, edges, judged.where("problem IS NOT NULL").select("accession_number", "problem")


def import_capacity(capacity: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact-quarter claim rows summed per selection, and problems per selected claim.

    ``capacity(claim_id, metric, unit, basis, period_start, period_end, low, base, high, confidence,
    claim_kind)``; ``selections(selection_id, claim_ids, metric, unit, basis, target_quarter)``.
    """
    wanted = selections.withColumn("_sorted", is_sorted_unique("claim_ids")).select(
        "selection_id", F.explode("claim_ids").alias("claim_id"), "target_quarter", "_sorted", F.col("metric").alias("_metric"),
        F.col("unit").alias("_unit"), F.col("basis").alias("_basis"),
    )
    fields = [c for c in capacity.columns if c != "claim_id"]
    rows = match_exactly_one(wanted, capacity, ["claim_id"], fields)
    exact = (F.col("period_start") == quarter_start("target_quarter")) & (F.col("period_end") == quarter_end_exclusive("target_quarter"))
    problem = (
        F.when(~F.col("_sorted"), "ids_not_sorted_unique")
        .when(F.col("matches") != 1, "claim_not_unique")
        .when(F.col("metric") != F.col("_metric"), "metric_mismatch")
        .when(F.col("unit") != F.col("_unit"), "unit_mismatch")
        .when(F.col("basis") != F.col("_basis"), "basis_mismatch")
        .when(~F.coalesce(exact, F.lit(False)), "quarter_not_covered")
        .when(~((F.col("low") <= F.col("base")) & (F.col("base") <= F.col("high"))), "range_unordered")
    )
    judged = rows.withColumn("problem", problem)
    failed = judged.where("problem IS NOT NULL").select("selection_id", "claim_id", "problem")
    clean = judged.join(failed.select("selection_id").distinct(), "selection_id", "left_anti")
    reported = F.col("claim_kind").isin("source_statement", "direct_observation")
    return sum_ranges(clean, ["selection_id"], reported), failed


def capacity_evidence(selections: DataFrame, claims: DataFrame, edges: DataFrame, evidence: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence rows of all claims that each selection rests on, and what is wrong with a selection's closure.

    ``selections(selection_id, claim_ids)``; ``claims(claim_id)``; ``edges(claim_id, depends_on)``; ``evidence(link_id, claim_id, document_id, role,
    document_url, publisher, retrieved_at, source_family)``; ``documents(document_id, title)``. Problems ``(selection_id, key, problem)``: claims that
    are missing or lie on a cycle; evidence links that repeat, lack a document, an address, publisher or date, or whose document repeats; and
    no support at all. A selection with a problem has no evidence rows.
    """
    selected = selections.select("selection_id", F.explode("claim_ids").alias("claim_id")).distinct()
    closure = closure_per_selection(edges, selected)
    reached = closure.select("claim_id").distinct()
    inner = edges.join(reached, "claim_id", "left_semi")
    missing = closure.join(claims.select("claim_id"), "claim_id", "left_anti").withColumn("problem", F.lit("claim_missing"))
    cyclic = closure.join(cyclic_claims(inner), "claim_id", "left_semi").withColumn("problem", F.lit("dependency_cycle"))
    named = documents.groupBy("document_id").agg(F.count("*").alias("copies"), F.first("title").alias("title"))
    support = supporting_evidence(evidence, reached, named)
    links = evidence.where("role = 'support'").groupBy("link_id").agg(F.count("*").alias("uses"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    problem = (
        F.when(blank("link_id"), "link_missing").when(F.col("uses") > 1, "link_not_unique").when(F.col("copies").isNull(), "document_missing").when(F.col("copies") > 1, "document_not_unique")
        .when(blank("document_url"), "document_url_missing").when(blank("publisher"), "publisher_missing").when(blank("retrieved_at"), "retrieved_at_missing")
    )
    title = F.when(blank("title"), F.col("document_url")).otherwise(F.col("title"))
    kind = evidence_kind_from_text("source_family", "publisher", "document_url")
    judged = support.join(links, "link_id", "left").select("link_id", "claim_id", "document_id", title.alias("title"), kind.alias("kind"), "document_url", "publisher", "retrieved_at", problem.alias("problem"))
    rows = closure.join(judged, "claim_id")
    none = selected.select("selection_id").distinct().join(rows.select("selection_id"), "selection_id", "left_anti")
    problems = [x.select("selection_id", F.col("claim_id").cast("string").alias("key"), "problem") for x in (missing, cyclic)]
    problems.append(rows.where("problem IS NOT NULL").select("selection_id", F.col("link_id").cast("string").alias("key"), "problem").distinct())
    problems.append(none.select("selection_id", F.lit(None).cast("string").alias("key"), F.lit("no_support").alias("problem")))
    wrong = union_all(problems)
    return rows.drop("problem").join(wrong.select("selection_id"), "selection_id", "left_anti"), wrong


def import_forecast(forecasts: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pinned vintage's single target-quarter row of each selected claim, summed; modeled posture."""
    wanted = selections.select(
        "selection_id", F.explode("claim_ids").alias("claim_id"), F.col("target_quarter").alias("quarter"), F.col("forecast_vintage").alias("_vintage")
    )
    rows = match_exactly_one(wanted, forecasts, ["claim_id", "quarter"], ["forecast_vintage", "low", "base", "high", "confidence"])
    problem = F.when(F.col("matches") != 1, "forecast_not_unique").when(F.col("forecast_vintage") != F.col("_vintage"), "vintage_mismatch")
    judged = rows.withColumn("problem", problem)
    failed = judged.where("problem IS NOT NULL").select("selection_id", "claim_id", "problem")
    clean = judged.join(failed.select("selection_id").distinct(), "selection_id", "left_anti")
    return sum_ranges(clean, ["selection_id"], F.lit(False), "modeled"), failed


def site_power_evidence(selections: DataFrame, failed: DataFrame, site_evidence: DataFrame, capacity_evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of the sites and capacity rows of each clean selection, united by id; and what is wrong.

    Both evidence tables are ``(entity_id, id, …)`` with equal further columns; ``failed`` is that of ``import_site_power``. Problems
    ``(selection_id, key, problem)``: a selected site without capacity evidence, and an id that comes with two contents.
    """
    chosen = selections.select("selection_id", F.explode("entity_ids").alias("entity_id")).distinct().join(failed.select("selection_id"), "selection_id", "left_anti")
    lost = chosen.join(capacity_evidence.select("entity_id"), "entity_id", "left_anti")
    parts = [chosen.join(rows, "entity_id").drop("entity_id") for rows in (site_evidence, capacity_evidence)]
    united = union_evidence(*parts, key=["selection_id", "id"])
    problems = lost.select("selection_id", F.col("entity_id").cast("string").alias("key"), F.lit("capacity_evidence_missing").alias("problem")).unionByName(
        united.where("conflict").select("selection_id", F.col("id").cast("string").alias("key"), F.lit("evidence_conflict").alias("problem"))
    )
    return united.drop("conflict").join(problems.select("selection_id"), "selection_id", "left_anti"), problems


def import_site_power(sites: DataFrame, capacity: DataFrame, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gross power envelope of the chosen sites per selection; never a net number.

    ``selections(selection_id, entity_ids, countries, user_labels, stage, minimum_as_of, target_quarter)``;
    ``sites(entity_id, country, users)``; ``capacity(entity_id, stage, as_of_date, target_date, low, base,
    high, confidence, method)``.
    """
    chosen = selections.select(
        "selection_id", F.explode("entity_ids").alias("entity_id"), "countries", "user_labels", "stage", "minimum_as_of",
        quarter_end_exclusive("target_quarter").alias("_end"),
    ).join(sites, "entity_id", "left")
    rows = match_exactly_one(chosen, capacity, ["entity_id", "stage"], ["as_of_date", "target_date", "low", "base", "high", "confidence", "method"])
    inside = in_capacity_window("as_of_date", "target_date", "stage", "minimum_as_of", "_end")
    problem = (
        F.when(F.col("users").isNull(), "site_missing")
        .when((F.size("countries") > 0) & ~F.array_contains("countries", F.col("country")), "country_mismatch")
        .when(~has_tokens("users", "user_labels"), "user_label_mismatch")
        .when(F.col("matches") != 1, "capacity_row_not_unique")
        .when(~F.coalesce(inside, F.lit(False)), "outside_window")
        .when(~((F.col("low") <= F.col("base")) & (F.col("base") <= F.col("high"))), "range_unordered")
    )
    judged = rows.withColumn("problem", problem)
    failed = judged.where("problem IS NOT NULL").select("selection_id", "entity_id", "problem")
    clean = judged.join(failed.select("selection_id").distinct(), "selection_id", "left_anti")
    total = sum_ranges(clean, ["selection_id"], F.col("method") == "reported", "modeled")
    return total.withColumn("basis", F.lit("gross_site_envelope")), failed
