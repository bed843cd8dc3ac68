"""Projection, filter, recode and staged-correction operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlog.functions.labels import map_values


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (version-only or temporary ones)."""
    have = set(df.columns)
    return df.drop(*[c for c in cols if c in have])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in have})


def select_renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``select(new = old, ...)``: keep and rename in one projection."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def union_all(frames: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    """Union by column name: strict (same column set, ``rbind``) or filling
    absent columns with NULL (``bind_rows``)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=fill_missing)
    return out


def keep_known(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is not NULL (``filter(!is.na(col))``)."""
    return df.where(F.col(col).isNotNull())


def exclude_keys(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Drop rows whose ``col`` is in ``values``.

    Like ``filter(!col == v)`` a NULL key is dropped as well.  A Python list
    becomes an ``IN`` predicate (pushed to the scan); a DataFrame of keys
    (its first column) becomes a left-anti join, broadcast where Spark finds
    it small.
    """
    c = F.col(col)
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(col)).where(F.col(col).isNotNull())
        typed = keys.select(F.col(col).cast(dict(df.dtypes)[col]).alias(col)).distinct()
        return df.where(c.isNotNull()).join(typed, col, "left_anti")
    vals = list(values)
    if not vals:
        return df
    return df.where(~c.isin(vals))


def slice_by(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter (category or role slice)."""
    return df.where(F.col(col) == F.lit(value))


def where_has_subcategory(df: DataFrame, col: str = "subcategory", none_value: str = "0") -> DataFrame:
    """``Subcategories != 0``: compared as text, NULL dropped."""
    return df.where(F.col(col) != F.lit(none_value))


def tool_used(flags: Sequence[str]) -> Column:
    """True when any tool flag is 1 (``how != "None"`` on the folded label)."""
    cond = F.lit(False)
    for f in flags:
        cond = cond | F.coalesce(F.col(f) == 1, F.lit(False))
    return cond


def where_tool_used(df: DataFrame, flags: Sequence[str] = ("how_paper", "how_desktop",
                                                           "how_mobile", "how_phone")) -> DataFrame:
    return df.where(tool_used(flags))


def where_matches(df: DataFrame, col: str, pattern: str, ignore_case: bool = True) -> DataFrame:
    """Regex filter (``str_detect(col, regex(p, ignore_case))``); NULL dropped."""
    return df.where(F.col(col).rlike(("(?i)" if ignore_case else "") + pattern))


def recode(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace known misspellings of a category; other values unchanged."""
    if not mapping:
        return df
    return df.withColumn(col, map_values(F.col(col), mapping))


def fill_null(df: DataFrame, value, subset: Sequence[str] | None = None) -> DataFrame:
    """``mutate(across(everything(), replace_na, value))`` on ``subset``."""
    return df.na.fill(value, subset=list(subset) if subset else None)


# ---------------------------------------------------------------------------
# Corrections as data

@dataclass(frozen=True)
class Correction:
    """Overwrite ``target`` with ``new_value`` where ``match_column == match_value``.

    ``stage`` orders it in the cleaning chain: ``raw`` (before lookups),
    ``derived`` (after derived columns), ``late`` (after exclusions: later
    derived columns are *not* refreshed), ``normalised`` (after
    session-relative times).  ``dataset`` scopes it to one log.
    """

    dataset: str
    stage: str
    match_column: str
    match_value: object
    target: str
    new_value: object


def apply_corrections(df: DataFrame, corrections: Iterable[Correction], stage: str,
                      dataset: str | None = None) -> DataFrame:
    """Apply the corrections of one stage in list order.

    Each correction sees the result of the previous one (``mutate``
    semantics: a merged session id is matched by the next fix).  Values are
    cast to the column types, so a correction table holds text.
    """
    types = dict(df.dtypes)
    for c in corrections:
        if c.stage != stage or (dataset is not None and c.dataset != dataset):
            continue
        if c.match_column not in types or c.target not in types:
            continue
        match = F.lit(c.match_value).cast(types[c.match_column])
        new = F.lit(c.new_value).cast(types[c.target])
        df = df.withColumn(c.target, F.when(F.col(c.match_column) == match, new)
                           .otherwise(F.col(c.target)))
    return df


def apply_correction_table(df: DataFrame, table: DataFrame, key: str, target: str,
                           value_col: str = "new_value") -> DataFrame:
    """Keyed corrections held as a DataFrame (``key``, ``value_col``): a left
    join plus ``coalesce``; of several rows of a key the greatest value."""
    t = (table.select(F.col(key), F.col(value_col).alias("__fix__"))
         .groupBy(key).agg(F.max("__fix__").alias("__fix__")))
    out = df.join(t, key, "left")
    typ = dict(df.dtypes)[target]
    return out.withColumn(target, F.coalesce(F.col("__fix__").cast(typ), F.col(target))) \
              .drop("__fix__")


#: Columns of a table of corrections; ``match_value`` and ``new_value`` are text.
CORRECTION_SCHEMA = ("dataset string, stage string, seq int, match_column string, "
                     "match_value string, target string, new_value string")


@dataclass(frozen=True)
class CorrectionTable:
    """Corrections and exclusions as data, joined when the chain runs.

    ``rows`` has :data:`CORRECTION_SCHEMA`.  ``steps`` are the (stage, match
    column, target) it may hold, in the order they apply: the plan has one
    join per step, whatever the number of rows; :meth:`check` raises at rows
    of other steps.  Several rows of one step and key apply in order of ``seq``,
    so the last one holds.
    """

    rows: DataFrame
    steps: Sequence[tuple[str, str, str]]
    dataset: str

    def check(self) -> None:
        """Raises where a row belongs to no step (one look at the table)."""
        known = F.lit(False)
        for stage, match, target in self.steps:
            known = known | ((F.col("stage") == stage) & (F.col("match_column") == match)
                             & (F.col("target") == target))
        lost = (self.rows.where((F.col("dataset") == self.dataset)
                                & ~F.coalesce(known, F.lit(False))).limit(1).collect())
        if lost:
            raise ValueError(f"no step applies the correction {lost[0].asDict()}")

    def apply(self, df: DataFrame, stage: str) -> DataFrame:
        """The corrections of one stage; a step sees what earlier ones wrote.
        NULL keys match nothing; a value that the column's type does not take
        becomes NULL, as does a NULL ``new_value``."""
        types = dict(df.dtypes)
        for own, match, target in self.steps:
            if own != stage or match not in types or target not in types:
                continue
            fix = (self.rows
                   .where((F.col("dataset") == self.dataset) & (F.col("stage") == own) & (F.col("match_column") == match)
                          & (F.col("target") == target))
                   .select(F.col("match_value").try_cast(types[match]).alias("__match"), "seq",
                           F.struct(F.col("new_value").try_cast(types[target]).alias("v"))
                           .alias("__fix"))
                   .groupBy("__match").agg(F.max_by("__fix", "seq").alias("__fix")))
            joined = df.join(fix, F.col(match) == F.col("__match"), "left")
            df = joined.withColumn(target, F.when(F.col("__fix").isNotNull(), F.col("__fix.v"))
                                   .otherwise(F.col(target))).select(*df.columns)
        return df
