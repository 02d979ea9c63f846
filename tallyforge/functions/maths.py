"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def let(value, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.transform(F.array(value), lambda bound: body(bound))[0]


def settle(value, places: int = 6) -> Column:
    """Quantise a double for stable output.

    The threshold is off the decimal grid, so a value that lies exactly half way between two
    neighbours lands on the same side whatever the order of summation was.
    """
    scale = float(10**places)
    return F.floor(col(value) * scale + 0.3217) / scale


def steady_sum(value) -> Column:
    """Sum of doubles that is the same in whatever order the rows come: multiples of 2**-20 add up without rounding (below 2**33), the rests are too small to matter.

    A plain sum may change its last bit, which decides comparisons of equal numbers.
    """
    whole = F.rint(col(value) * 1048576.0) / 1048576.0
    return F.sum(whole) + F.sum(col(value) - whole)


def is_close(a, b, rel: float = 1e-10, absolute: float = 1e-12) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def safe_ratio(a, b, on_zero: float | None = 0.0) -> Column:
    """``a / b`` with the stated result (0 or null) for a zero denominator."""
    a, b = col(a), col(b)
    return F.when(b == 0, F.lit(on_zero).cast("double")).otherwise(a / b)


def relative_change(previous, current) -> Column:
    """0 when both are about zero, null when only the previous one is."""
    p, c = col(previous), col(current)
    near = lambda x: is_close(x, F.lit(0.0), 1e-9, 1e-12)
    return F.when(near(p), F.when(near(c), F.lit(0.0))).otherwise((c - p) / F.abs(p))


def interval_miss(low, high, actual) -> Column:
    return F.greatest(col(low) - col(actual), col(actual) - col(high), F.lit(0.0))


def half_width_scale(low, middle, high) -> Column:
    return F.greatest((col(high) - col(low)) / 2, F.abs(col(middle)) * 0.01, F.lit(1e-12))


def pinball(prediction, actual, quantile: float) -> Column:
    error = col(actual) - col(prediction)
    return F.when(error >= 0, error * quantile).otherwise(error * (quantile - 1))


def system_equivalents(capacity, effective_yield, allocation, units_per_system) -> Column:
    return col(capacity) * col(effective_yield) * col(allocation) / col(units_per_system)


def keyed_uniform(seed, key, index) -> Column:
    """Deterministic uniform in [0, 1): depends only on its arguments, never on partitioning."""
    text = F.concat_ws(":", col(seed).cast("string"), col(key).cast("string"), col(index).cast("string"))
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def triangular_inverse(u, low, mode, high) -> Column:
    u, a, m, b = col(u), col(low), col(mode), col(high)
    span = b - a
    rising = a + F.sqrt(F.greatest(u * span * (m - a), F.lit(0.0)))
    falling = b - F.sqrt(F.greatest((1 - u) * span * (b - m), F.lit(0.0)))
    return F.when(span == 0, a).when(u * span < m - a, rising).otherwise(falling)


def triangular_cdf(low, mode, high, value) -> Column:
    a, m, b, x = col(low), col(mode), col(high), col(value)
    return (
        F.when(a == b, F.when(x < a, 0.0).otherwise(1.0))
        .when(x <= a, 0.0)
        .when(x >= b, 1.0)
        .when(x <= m, F.when(m == a, 0.0).otherwise((x - a) * (x - a) / ((b - a) * (m - a))))
        .otherwise(F.when(m == b, 1.0).otherwise(1 - (b - x) * (b - x) / ((b - a) * (b - m))))
    )


def event_realized(operator, threshold, actual) -> Column:
    return F.when(col(operator) == F.lit("at_least"), col(actual) >= col(threshold)).otherwise(
        col(actual) <= col(threshold)
    )


def triangular_event_probability(p10, p50, p90, operator, threshold) -> Column:
    """Event probability with p10/p50/p90 as low/mode/high; a point mass is decided by p50."""
    point = event_realized(operator, threshold, p50).cast("double")
    cdf = triangular_cdf(p10, p50, p90, threshold)
    spread = F.when(col(operator) == F.lit("at_least"), 1 - cdf).otherwise(cdf)
    return F.when(col(p10) == col(p90), point).otherwise(spread)


def brier(probability, realized) -> Column:
    gap = col(probability) - col(realized).cast("double")
    return gap * gap


def gross_dies_per_wafer(diameter, edge, width, height, scribe) -> Column:
    """Gross rectangular dies: usable circle area over the stepped die area, less the edge loss."""
    usable = col(diameter) - col(edge) * 2
    area = (col(width) + col(scribe)) * (col(height) + col(scribe))
    inside = F.lit(3.141592653589793) * usable * usable / 4 / area
    rim = F.lit(3.141592653589793) * usable / F.sqrt(area * 2)
    return F.greatest(inside - rim, F.lit(0.0))


def negative_binomial_yield(defects_per_cm2, die_area_mm2, alpha) -> Column:
    return F.pow(1 + col(defects_per_cm2) * (col(die_area_mm2) / 100) / col(alpha), -col(alpha))


def range_position(low, high, actual) -> Column:
    return (
        F.when(col(actual).between(col(low), col(high)), "inside_range")
        .when(col(actual) > col(high), "above_range")
        .otherwise("below_range")
    )
