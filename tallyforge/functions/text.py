"""Text and identifier column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import col

# Identifier patterns.
ID_PATTERNS = {
    "accession": r"^\d{10}-\d{2}-\d{6}$",
    "quarter": r"^\d{4}-Q[1-4]$",
    "slug": r"^[a-z0-9]+(-[a-z0-9]+)*$",
    "sha256": r"^[0-9a-f]{64}$",
}

# Media type by file extension; anything else is a byte stream.
MEDIA_TYPES = {
    "htm": "text/html",
    "html": "text/html",
    "txt": "text/plain",
    "xml": "application/xml",
    "json": "application/json",
    "pdf": "application/pdf",
}

# Fixed value: base of the public filing archive.
ARCHIVE_BASE = "https://www.sec.gov/Archives/edgar/data"

# Named character references that markup itself needs; the ampersand last, as it begins all others.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "amp": "&"}

# Tags whose content is not visible text.
HIDDEN_TAGS = ("script", "style", "noscript")

# Source kinds that map onto an evidence kind; every other kind is "other".
SOURCE_KINDS = {
    "company_disclosure": "company_disclosure",
    "government_record": "government_record",
    "satellite_imagery": "satellite_imagery",
    "utility_record": "utility_record",
    "third_party_research": "third_party_research",
    "third_party_dataset": "third_party_research",
}


def matches_id(value, kind: str) -> Column:
    return col(value).rlike(ID_PATTERNS[kind])


def normalize_ws(value) -> Column:
    return F.trim(F.regexp_replace(col(value), r"(?U)\s+", " "))


def snippet(text, start, end, context: int) -> Column:
    """Text around ``[start, end)`` (0-based, half open) clipped to the text."""
    begin = F.greatest(col(start) - context, F.lit(0))
    stop = F.least(col(end) + context, F.char_length(col(text)))
    return F.substring(col(text), begin + 1, stop - begin)


def literal_pieces(text, literal) -> Column:
    """The text between case-insensitive, non-overlapping matches of a literal; one more piece than matches."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(col(literal), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.split(col(text), quoted, -1)


def spans_of_pieces(pieces, literal, limit: int | None = None) -> Column:
    """Array of ``struct(occurrence, character_start, character_end)``, of the first ``limit`` matches only if given.

    Offsets count code points, because they are summed from the lengths of the pieces between
    matches instead of taken from regex positions.
    """
    pieces, width = col(pieces), F.char_length(col(literal))
    matches = F.greatest(F.size(pieces) - 1, F.lit(0))
    wanted = matches if limit is None else F.least(matches, F.lit(limit))
    steps = F.transform(F.slice(pieces, F.lit(1), wanted), lambda piece: F.char_length(piece) + width)
    return F.transform(
        running_sums(steps),
        lambda stop, i: F.struct((i + 1).alias("occurrence"), (stop - width).alias("character_start"), stop.alias("character_end")),
    )


def running_sums(numbers: Column, part: int = 512) -> Column:
    """Sums of an array of ints up to and including each item. Parts are summed apart and then shifted, so long arrays take no square time."""

    def within(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
        step = lambda state, x: F.struct((state["at"] + x).alias("at"), F.array_append(state["sums"], state["at"] + x).alias("sums"))
        return F.aggregate(xs, start, step)["sums"]

    def shifted(parts: Column) -> Column:
        totals = within(F.transform(parts, lambda sums: F.element_at(sums, -1)))
        add = lambda ends: F.transform(parts, lambda sums, i: F.when(i == 0, sums).otherwise(F.transform(sums, lambda x: x + F.get(ends, i - 1))))
        return F.flatten(F.flatten(F.transform(F.array(totals), add)))

    def whole(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(part))).otherwise(F.array().cast("array<int>"))
        return shifted_once(F.transform(starts, lambda at: within(F.slice(xs, at, part))))

    # As an argument of a one-element transform an array is made once, however often the lambda names it.
    shifted_once = lambda parts: F.flatten(F.transform(F.array(parts), shifted))
    return F.flatten(F.transform(F.array(numbers), whole))


def literal_spans(text, literal) -> Column:
    return spans_of_pieces(literal_pieces(text, literal), literal)


def anchor_matches(text, start, end, expected) -> Column:
    return F.substring(col(text), col(start) + 1, col(end) - col(start)).eqNullSafe(col(expected))


def filing_url(cik, accession, document) -> Column:
    return F.concat_ws(
        "/",
        F.lit(ARCHIVE_BASE),
        col(cik).cast("bigint").cast("string"),
        F.replace(col(accession), F.lit("-"), F.lit("")),
        col(document),
    )


def join_ids(ids) -> Column:
    return F.concat_ws("|", col(ids))


def split_ids(text) -> Column:
    return F.filter(F.split(col(text), r"\|"), lambda x: x != "")


def media_type(file_name) -> Column:
    extension = F.lower(F.regexp_extract(col(file_name), r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit("application/octet-stream"))


def evidence_kind_from_text(source_family, publisher, url) -> Column:
    value = F.lower(F.concat_ws(" ", col(source_family), col(publisher), col(url)))
    public = value.contains("nist") | value.contains(".gov") | value.contains("government")
    return F.when(public, "government_record").otherwise("other")


def evidence_kind_from_source(kind) -> Column:
    pairs = [F.lit(x) for pair in SOURCE_KINDS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(kind)), F.lit("other"))


def _sign(digits: Column, base: int) -> Column:
    """The character of a number without leading zeros; U+FFFD where there is none: 0, surrogates and numbers beyond the last code point."""
    number = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("bigint"))
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decode_entities(text) -> Column:
    """Character references as the characters they stand for: the named ones of markup itself, and all numbered ones."""
    out = col(text)
    for pattern, digits, base in ((r"&#0*(\d+);?", r"&#\d+;?", 10), (r"&#[xX]0*([0-9A-Fa-f]+);?", r"&#[xX][0-9A-Fa-f]+;?", 16)):
        codes = F.regexp_extract_all(out, F.lit(pattern), F.lit(1))
        signs = F.transform(codes, lambda c: _sign(c, base))
        put = F.array_join(F.flatten(F.zip_with(F.split(out, digits, -1), signs, lambda piece, sign: F.array(piece, F.coalesce(sign, F.lit(""))))), "")
        out = F.when(out.rlike(digits), put).otherwise(out)
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def visible_text(html) -> Column:
    """The text a reader of the page sees: no hidden blocks, comments or tags, references decoded, white space collapsed.

    A tag ends at the first ``>`` outside quotes and parts words, as browsers break lines there. Its length is not limited: what was read is
    never given back, so the pattern needs no stack.
    """
    hidden = "|".join(rf"<{tag}\b[^>]*>.*?(?:</{tag}\s*>|$)" for tag in HIDDEN_TAGS)
    markup = rf"(?is){hidden}|<!--.*?(?:-->|$)|</?[a-z!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    return normalize_ws(decode_entities(F.regexp_replace(col(html), markup, " ")))
