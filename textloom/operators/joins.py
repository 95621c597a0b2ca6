"""Joins that hold where a key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splittable_join(rows: DataFrame, few: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join with a side that was aggregated by the same keys.

    Spark would take that side as it lies, without a shuffle of its own, and then can't split a task whose key is hot. A hash of the keys as a further key makes it shuffle both.
    """
    h = next(n for n in ("key_hash", "_key_hash", "__key_hash") if n not in {*rows.columns, *few.columns})
    return rows.withColumn(h, F.xxhash64(*keys)).join(few.withColumn(h, F.xxhash64(*keys)), [*keys, h], how).drop(h)
