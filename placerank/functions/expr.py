"""Scalar column expressions (all JVM built-ins, no Python UDFs)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placerank.sources.reference_values import EARTH_RADIUS_MILES

__all__ = [
    "col_of", "strip_ws", "category_tokens", "elite_years", "price_level", "to_ts", "elapsed_days",
    "haversine_miles", "dot", "clip", "text_to_bool", "is_finite", "null_safe_eq", "fill_zero",
]


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Strip all leading/trailing whitespace (``trim`` only strips blanks)."""
    return F.regexp_replace(col_of(c), r"^\s+|\s+$", "")


def category_tokens(c: str | Column) -> Column:
    """``'A, B'`` -> ``['a', 'b']``: split on ``', '``, strip, lower case; null stays null."""
    return F.transform(F.split(col_of(c), ", "), lambda x: F.lower(strip_ws(x)))


def elite_years(c: str | Column) -> Column:
    """Number of comma-separated years; null or empty -> 0."""
    c = col_of(c)
    return F.when(F.length(c) > 0, F.size(F.split(c, ","))).otherwise(F.lit(0))


def price_level(c: str | Column, default: float = 2.0) -> Column:
    """Tolerant numeric cast with a default for null / unparsable values."""
    return F.coalesce(col_of(c).try_cast("double"), F.lit(float(default)))


def to_ts(c: str | Column) -> Column:
    """Tolerant timestamp parse: bad text -> null (TIMESTAMP_NTZ, like the review dates)."""
    return F.try_to_timestamp(col_of(c)).cast("timestamp_ntz")


def elapsed_days(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed 24-hour days from start to end (not midnights crossed)."""
    return F.timestamp_diff("DAY", col_of(start), col_of(end))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in miles between two points in degrees."""
    p1, p2 = F.radians(col_of(lat1)), F.radians(col_of(lat2))
    dphi = p2 - p1
    dlmb = F.radians(col_of(lon2)) - F.radians(col_of(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2.0 * EARTH_RADIUS_MILES) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of element-wise products of two equal-length arrays."""
    return F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col_of(c), F.lit(float(lo))), F.lit(float(hi)))


def text_to_bool(c: str | Column) -> Column:
    """Attribute text -> 'True' if it contains 'true', 'False' if it contains 'false', else the text."""
    c = col_of(c)
    low = F.lower(c)
    return (F.when(low.contains("true"), F.lit("True"))
            .when(low.contains("false"), F.lit("False"))
            .otherwise(c))


def is_finite(c: str | Column) -> Column:
    c = col_of(c)
    return ~(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def null_safe_eq(a: str | Column, b: str | Column) -> Column:
    """Equality where a null on either side is *not equal* (pandas semantics)."""
    return F.coalesce(col_of(a) == col_of(b), F.lit(False))


def fill_zero(c: str | Column) -> Column:
    c = col_of(c)
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def bounded_broadcast(df, max_rows: int = 100_000):
    """Broadcast hint for a small input table only after a count proves it has at most
    ``max_rows`` rows; a larger table is left to the planner (shuffle join)."""
    from pyspark.sql import functions as _F
    n = df.limit(max_rows + 1).count()
    return _F.broadcast(df) if n <= max_rows else df
