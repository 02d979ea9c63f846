"""Quarter and timestamp column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import col


def quarter_start(quarter) -> Column:
    """First day of a ``YYYY-Qn`` quarter."""
    q = col(quarter)
    return F.make_date(F.left(q, F.lit(4)).cast("int"), F.right(q, F.lit(1)).cast("int") * 3 - 2, F.lit(1))


def quarter_end_exclusive(quarter) -> Column:
    return F.add_months(quarter_start(quarter), 3)


def quarter_end(quarter) -> Column:
    """Last day of the quarter."""
    return F.date_sub(quarter_end_exclusive(quarter), 1)


def quarter_of(day) -> Column:
    return F.concat(F.year(col(day)).cast("string"), F.lit("-Q"), F.quarter(col(day)).cast("string"))


# Fixed value: an ISO timestamp must name its zone.
ZONED_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def to_utc(text) -> Column:
    """Zoned ISO text as a timestamp (session zone UTC); text without a zone gives null."""
    return F.when(col(text).rlike(ZONED_PATTERN), F.try_to_timestamp(col(text)))


def maturity_status(as_of, cutoff, earliest, expected) -> Column:
    """Calendar state of a frozen forecast on a date."""
    return (
        F.when(col(as_of) <= col(cutoff), "pending_period_end")
        .when(col(as_of) < col(earliest), "pending_observation_window")
        .when(col(as_of) <= col(expected), "awaiting_outcome")
        .otherwise("outcome_overdue")
    )
