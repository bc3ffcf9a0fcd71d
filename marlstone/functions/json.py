"""JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_keys(c: Column | str) -> Column:
    """Distinct keys of an object; null for null, text that is no JSON, and JSON that is no object."""
    return F.array_distinct(F.json_object_keys(c))


def json_size(c: Column | str) -> Column:
    """Number of distinct keys, null as in json_keys."""
    keys = json_keys(c)
    return F.when(keys.isNotNull(), F.size(keys))
