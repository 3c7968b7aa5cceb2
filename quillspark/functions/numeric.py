"""Numbers: half-even rounding, token estimates, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def round_even(c: Column, digits: int) -> Column:
    """Half-even rounding of the decimal value (built-in ``round`` is half-up)."""
    return F.bround(c.cast("decimal(38,6)"), digits).cast("double")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) * F.lit(P.TOKENS_PER_CHAR)).cast("bigint")


def rate_percent(part: Column, total: Column) -> Column:
    """``part / total`` in percent with one digit; 0 when there is nothing to count."""
    return (F.when(total > 0, round_even(part.cast("double") / total.cast("double") * 100, 1))
            .otherwise(F.lit(0.0)))


def metres_to_km(c: Column) -> Column:
    return round_even(c / F.lit(1000.0), 2)


def seconds_to_minutes(c: Column) -> Column:
    return round_even(c / F.lit(60.0), 0).cast("bigint")


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour days between two timestamps (not midnights crossed)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / 86_400_000_000).cast("bigint")
