"""Array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tail(c: Column, n: int) -> Column:
    """Last ``n`` elements (``slice(c, -n, n)`` is empty when the array is shorter)."""
    return F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)


def head(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def non_empty(c: Column) -> Column:
    return c.isNotNull() & (F.size(c) > 0)


def stable_hash(key: Column, seed: str | int) -> Column:
    """Deterministic stand-in for random order; the same in every engine with md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
