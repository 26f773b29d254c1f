"""Field rows to wide records and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def pivot_fields(points: DataFrame, fields: Sequence[str], keys=("symbol", "time")) -> DataFrame:
    """One wide row per key from (field, value) rows; the field list is given, so nothing is scanned for it."""
    values = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return points.groupBy(*keys).agg(*values)


def unpivot_fields(wide: DataFrame, fields: Sequence[str], keys=("symbol", "time")) -> DataFrame:
    """One (field, value) row per non-null field."""
    typed = wide.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])
    return typed.unpivot(list(keys), list(fields), "field", "value").filter(F.col("value").isNotNull())
