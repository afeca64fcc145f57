"""Set signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(shared: Column, total: Column) -> Column:
    """Share of two counts; of nothing and nothing, 1."""
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / F.when(total != 0, total))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays without repeats; NULL if either is NULL. The intersection is made once: the
    ratio's operands are bound as one item of an array."""
    counts = F.array(F.struct(F.size(F.array_intersect(a, b)).alias("shared"), (F.size(a) + F.size(b)).alias("both")))
    return F.when(a.isNotNull() & b.isNotNull(), F.transform(counts, lambda x: ratio(x["shared"], x["both"] - x["shared"]))[0])


def or_null(items: Column) -> Column:
    """Sorted distinct items; NULL if there are none."""
    found = F.array_sort(F.array_distinct(items))
    return F.when(F.size(found) > 0, found)


def similarity(value: Column) -> Column:
    """A number from 0 to 1, else NULL."""
    return F.when(~F.isnan(value) & value.between(0.0, 1.0), value)


def is_at_least(value: Column, threshold: float) -> Column:
    """Inclusive; what isn't measured isn't."""
    return F.coalesce(value >= F.lit(float(threshold)), F.lit(False))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)
