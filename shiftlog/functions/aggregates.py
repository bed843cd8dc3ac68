"""NA-aware aggregate expressions.

The reference's aggregates differ from SQL's in three ways:

* ``sum/mean/min/max`` without ``na.rm`` return NA as soon as one input is
  NA  -> ``na="propagate"``;
* ``sum(x, na.rm=TRUE)`` of nothing is 0, not NULL -> ``na="skip"`` wraps
  sums in ``coalesce(.., 0)``;
* ``n_distinct`` counts NA as a value -> :func:`n_distinct`.

All are plain built-in aggregates, so partial (map-side) aggregation still
applies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _all_present(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def agg_sum(x: ColumnOrName, na: str = "propagate") -> Column:
    c = _c(x)
    if na == "skip":
        return F.coalesce(F.sum(c), F.lit(0))
    return F.when(_all_present(c), F.sum(c))


def agg_mean(x: ColumnOrName, na: str = "propagate") -> Column:
    c = _c(x)
    return F.avg(c) if na == "skip" else F.when(_all_present(c), F.avg(c))


def agg_max(x: ColumnOrName, na: str = "propagate") -> Column:
    c = _c(x)
    return F.max(c) if na == "skip" else F.when(_all_present(c), F.max(c))


def agg_min(x: ColumnOrName, na: str = "propagate") -> Column:
    c = _c(x)
    return F.min(c) if na == "skip" else F.when(_all_present(c), F.min(c))


def n_distinct(x: ColumnOrName, approx: bool = False) -> Column:
    """Distinct count where NULL counts as one more value.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``) so the
    count needs no per-key shuffle of the distinct values at large scale.
    """
    c = _c(x)
    base = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return base + F.max(F.when(c.isNull(), 1).otherwise(0)).cast("bigint")


def mean_table(x: ColumnOrName) -> Column:
    """``mean(table(x))``: rows per distinct non-NULL value (NULL dropped)."""
    c = _c(x)
    return F.try_divide(F.count(c).cast("double"), F.count_distinct(c).cast("double"))
