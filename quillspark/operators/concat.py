"""Ordered string aggregation in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(order: Column | str, value: str, sep: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), sep)


def concat_ordered(df: DataFrame, keys: list[str], order: str, value: str, sep: str = "\n",
                   block: int = 1024) -> DataFrame:
    """Concatenate ``value`` per key in the order of the integer column ``order``.

    Blocks of ``block`` positions are joined first, so no task sorts more than a
    block of rows, or one row per block, of a single key.
    """
    blocks = (df.groupBy(*keys, F.floor(F.col(order) / block).alias("_blk"))
              .agg(_joined(order, value, sep).alias("_part")))
    return blocks.groupBy(*keys).agg(_joined("_blk", "_part", sep).alias(value))
