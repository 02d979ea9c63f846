"""Ids, arrays, maps and JSON values as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import col, let

# Dimensions every claim must carry.
CORE_DIMENSIONS = ("entity_scope", "geography", "period", "stage", "capacity_basis", "quantity_semantics")

# Dimensions a claim may carry.
OPTIONAL_DIMENSIONS = ("product", "process_node", "customer", "technology", "qualifier")


def row_digest(**fields) -> Column:
    """SHA-256 over the JSON of the named fields in name order."""
    parts = [col(fields[name]).alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def content_id(prefix: str, length: int, **fields) -> Column:
    return F.concat(F.lit(prefix), F.left(row_digest(**fields), F.lit(length)))


def is_sorted_unique(values) -> Column:
    return col(values).eqNullSafe(F.array_sort(F.array_distinct(col(values))))


def tokens(text) -> Column:
    """Non-blank trimmed items of a comma list."""
    return F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_tokens(text, required) -> Column:
    return F.size(F.array_except(col(required), tokens(text))) == 0


def dimension_map_errors(dimensions, required, optional) -> Column:
    """Codes for a closed-key map: missing or blank required keys, unknown keys."""
    dims = col(dimensions)
    keys = F.map_keys(dims)
    need = F.array(*[F.lit(x) for x in required])
    known = F.array(*[F.lit(x) for x in (*required, *optional)])
    absent = F.transform(F.array_except(need, keys), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))
    blank = F.transform(
        F.map_keys(F.map_filter(dims, lambda k, v: F.trim(v) == "")),
        lambda k: F.concat(F.lit("blank:"), k),
    )
    return F.array_sort(F.concat(absent, unknown, blank))


def dimension_mismatches(claim, target) -> Column:
    """``dimension_mismatch:<field>`` for every target field the claim does not equal."""
    fields = F.filter(
        F.array_sort(F.map_keys(col(target))),
        lambda k: ~F.try_element_at(col(claim), k).eqNullSafe(F.try_element_at(col(target), k)),
    )
    return F.transform(fields, lambda k: F.concat(F.lit("dimension_mismatch:"), k))


def json_number(json_text, path: str = "$") -> Column:
    """Numeric value at a path of a JSON text; null when absent or of another type."""
    value = F.try_parse_json(col(json_text))
    numeric = F.schema_of_variant(F.try_variant_get(value, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    return F.when(numeric, F.try_variant_get(value, path, "double"))


def json_text(json_value, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(col(json_value)), path, "string")


def json_kind(json_value) -> Column:
    """``number``, ``text``, ``boolean``, ``object``, ``array`` or ``null`` of a JSON text."""
    kind = F.schema_of_variant(F.try_parse_json(col(json_value)))
    return (
        F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number")
        .when(kind.startswith("STRING"), "text")
        .when(kind.startswith("BOOLEAN"), "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def normalized_range(json_value, multiplier) -> Column:
    """Claim value × multiplier as ``struct(low, base, high, blocker)``.

    A number is a point, an object with exactly low/base/high is a range; everything else gives a
    blocker code and null bounds.
    """

    def parts(text: Column) -> Column:
        kind = json_kind(text)
        return F.struct(
            kind.alias("kind"),
            F.array_sort(F.json_object_keys(text)).alias("keys"),
            json_number(text).alias("point"),
            *[json_number(text, f"$.{name}").alias(name) for name in ("low", "base", "high")],
        )

    def judged(p: Column) -> Column:
        named = lambda *names: p["keys"] == F.array(*[F.lit(n) for n in names])
        full = (p["kind"] == "object") & named("base", "high", "low")
        numeric = p["low"].isNotNull() & p["base"].isNotNull() & p["high"].isNotNull()
        ordered = (p["low"] <= p["base"]) & (p["base"] <= p["high"])
        blocker = (
            F.when(p["kind"] == "number", F.lit(None).cast("string"))
            .when(full & ~numeric, "nonnumeric_range")
            .when(full & ~ordered, "range_is_not_ordered")
            .when(full, F.lit(None).cast("string"))
            .when((p["kind"] == "object") & named("high", "low"), "range_has_no_base")
            .otherwise("value_is_not_numeric_capacity")
        )
        bound = lambda name: F.when(p["kind"] == "number", p["point"]).otherwise(p[name])
        return F.struct(
            *[F.when(full & numeric & ordered | (p["kind"] == "number"), bound(n) * col(multiplier)).alias(n) for n in ("low", "base", "high")],
            blocker.alias("blocker"),
        )

    return let(let(col(json_value), parts), judged)


def normalized_posture(posture, multiplier) -> Column:
    """A converted number is derived, an unconverted one keeps its posture."""
    return F.when(col(multiplier) == 1, col(posture)).otherwise("derived")


def assessment_status(accepted, eligible, usage) -> Column:
    return F.when(~col(accepted), "rejected").when(col(eligible), "constraint_eligible").otherwise(col(usage))
