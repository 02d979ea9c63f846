"""Explicit schemas of the tables the readers, the ledger and the streams exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SIMPLE = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "dimensions": T.MapType(T.StringType(), T.StringType()),
}


def table(required: tuple[str, ...] = (), **columns: str) -> T.StructType:
    """``table(id="bigint", name="string")``; names in ``required`` are not nullable."""
    return T.StructType([T.StructField(name, SIMPLE[kind], name not in required) for name, kind in columns.items()])


ESTIMATES = table(
    scenario_id="string", input_path="string", low="double", base="double", high="double", unit="string", posture="string", methodology="string",
    confidence="double", last_updated="date", evidence_ids="strings", confirming_evidence="string", falsifying_evidence="string", correlation_group="string",
)
EVIDENCE = table(
    id="string", kind="string", title="string", source_url="string", publisher="string", retrieved_at="timestamp", published_at="timestamp",
    source_family="string", license="string", excerpt="string", content_hash="string",
)
CLAIM_REVISIONS = table(
    revision_id="string", claim_key="string", subject="string", predicate="string", value_json="string", unit="string", posture="string", status="string",
    dimensions="dimensions", valid_from="date", valid_to="date", recorded_at="timestamp", methodology="string", confidence="double",
    confirming_evidence="string", falsifying_evidence="string", supersedes_revision_id="string",
)
CLAIM_EVIDENCE = table(revision_id="string", snapshot_id="string", evidence_role="string", independence_group="string")
SOURCE_SNAPSHOTS = table(
    snapshot_id="string", content_sha256="string", byte_count="bigint", capture_kind="string", media_type="string", source_url="string", publisher="string",
    source_family="string", published_at="timestamp", retrieved_at="timestamp", license="string",
)
DRAWS = table(scenario_id="string", draw_index="bigint", metric="string", value="double")
CYCLE_REVISIONS = table(
    claim_key="bigint", revision_id="bigint", recorded_at="timestamp", value="double", valid_from="date", valid_to="date", status="string", supersedes_revision_id="bigint"
)
CYCLES = table(known_at="timestamp", batch_id="bigint")
ATTEMPTS = table(event_id="string", sink_kind="string", attempted_at="timestamp", outcome="string", attempt_id="string")
ACKNOWLEDGEMENTS = table(event_id="string", acknowledged_at="timestamp", acknowledged_by="string")
OUTBOX = table(event_id="string", payload_sha256="string", payload_json="string", created_at="timestamp")
