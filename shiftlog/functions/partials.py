"""Measures that can be taken from the log or from partial states of it.

A table with role slices needs every measure twice: for all rows and per role.
Grouping sets over the log would double its rows; instead the log is aggregated
once per (role, key) -- with the counted ids as further keys where a measure
counts distinct ones -- and the grouping sets run over those few rows, merging
sums, counts, extremes and id lists.

A table's measures are written once, against :class:`Rows` or :class:`States`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


class Rows:
    """Measures straight from the rows."""

    def n(self) -> Column:
        return F.count(F.lit(1))

    def count(self, x: Column) -> Column:
        return F.count(x)

    def sum(self, x: Column) -> Column:
        return F.sum(x)

    def max(self, x: Column) -> Column:
        return F.max(x)

    def min(self, x: Column) -> Column:
        return F.min(x)

    def distinct(self, column: str, approx: bool = False) -> Column:
        """Distinct values, NULL counting as one more."""
        values = F.approx_count_distinct(column) if approx else F.count_distinct(column)
        return values + F.max(F.when(F.col(column).isNull(), 1).otherwise(0)).cast("bigint")

    def items(self, x: Column, name: str) -> Column:
        """The distinct values of a category, sorted."""
        return F.array_sort(F.collect_set(x))


class States(Rows):
    """The same measures from partial states; collects what these must hold."""

    def __init__(self) -> None:
        self.keys: dict[str, Column] = {}
        self.parts: dict[str, Column] = {}

    def _part(self, kind: str, state: Column) -> Column:
        name = f"__{kind}_{len(self.parts)}"
        for known, other in self.parts.items():
            if str(other) == str(state):
                name = known
        self.parts[name] = state
        return F.col(name)

    def n(self) -> Column:
        return F.sum(self._part("n", F.count(F.lit(1))))

    def count(self, x: Column) -> Column:
        return F.sum(self._part("count", F.count(x)))

    def sum(self, x: Column) -> Column:
        return F.sum(self._part("sum", F.sum(x)))

    def max(self, x: Column) -> Column:
        return F.max(self._part("max", F.max(x)))

    def min(self, x: Column) -> Column:
        return F.min(self._part("min", F.min(x)))

    def distinct(self, column: str, approx: bool = False) -> Column:
        if not approx:
            self.keys[column] = F.col(column)
            return super().distinct(column)
        sketch = self._part("hll", F.hll_sketch_agg(F.col(column)))
        missing = self._part("null", F.max(F.when(F.col(column).isNull(), 1).otherwise(0)))
        return F.hll_sketch_estimate(F.hll_union_agg(sketch)) + F.max(missing).cast("bigint")

    def items(self, x: Column, name: str) -> Column:
        self.keys[name] = x
        return F.array_sort(F.collect_set(name))


def all_present(m: Rows, x: Column) -> Column:
    return m.count(x) == m.n()


def sum_of(m: Rows, x: Column, na: str = "propagate") -> Column:
    """Sum: NULL if any input is, or with ``na="skip"`` of the others (0 of
    none)."""
    if na == "skip":
        return F.coalesce(m.sum(x), F.lit(0))
    return F.when(all_present(m, x), m.sum(x))


def mean_of(m: Rows, x: Column) -> Column:
    return F.when(all_present(m, x), F.try_divide(m.sum(x), m.count(x).cast("double")))


def sliced(df: DataFrame, keys: Sequence[str], measures: Callable[[Rows], Sequence[Column]],
           role: str | None = None, roles: Sequence[str] | None = None,
           all_label: str = ALL) -> tuple[DataFrame, list[str]]:
    """``measures`` per ``keys``; with ``role`` also per role: column
    ``role_slice`` (``all_label``, or the role, NULL being one) comes first.
    ``roles`` keeps only the listed slices besides all.  Returns the table and
    the slice columns it has."""
    keys = list(keys)
    if role is None:
        return df.groupBy(*keys).agg(*measures(Rows())), []
    states = States()
    wanted = measures(states)
    ids = [x.alias(name) for name, x in states.keys.items() if name not in (role, *keys)]
    few = df.groupBy(role, *keys, *ids).agg(*[x.alias(name) for name, x in states.parts.items()])
    label = F.when(F.grouping(role) == 1, F.lit(all_label)).otherwise(F.col(role))
    agg = (few.groupingSets([[role, *keys], keys], role, *keys)
           .agg(*wanted, label.alias("role_slice")).drop(role))
    if roles is not None:
        agg = agg.where(F.col("role_slice").isin([all_label, *roles]))
    return agg, ["role_slice"]
