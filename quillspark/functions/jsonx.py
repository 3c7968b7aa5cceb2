"""JSON found inside free text, and JSON-array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def embedded_array(c: Column) -> Column:
    """Text from the first ``[`` to the last ``]`` without code fences; '' if there is none."""
    return F.regexp_extract(F.regexp_replace(c, P.CODE_FENCE, ""), P.JSON_ARRAY, 0)


def embedded_object(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; '' if there is none."""
    return F.regexp_extract(c, P.JSON_OBJECT, 0)


def string_array(c: Column) -> Column:
    """A JSON array of strings as ``array<string>``; null or broken input gives an empty array."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(c, "array<string>"), empty)
