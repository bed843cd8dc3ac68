"""Overview tables of the notebooks: activity / subcategory shares, tool and
location breakdowns, headcounts, dataset overview, and their long (heat-map)
forms.  Role slices come from one grouping-sets pass, not one job per role.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlog.functions.aggregates import n_distinct
from shiftlog.functions.labels import label_roles
from shiftlog.functions.partials import Rows, sliced, sum_of
from shiftlog.functions.rounding import heat, pct_label, round_to
from shiftlog.operators.cleaning import tool_used, where_has_subcategory
from shiftlog.operators.summaries import ACT_MIN, SESSION, grand_total_share, sort_small

# ---------------------------------------------------------------------------
# Activity share (A7, A19, O3, R5) and subcategory share (A8)

def _time_skipping_na(m: Rows) -> list[Column]:
    return [sum_of(m, F.col(ACT_MIN), na="skip").alias("activity_time")]


def activity_share(df: DataFrame, key: str = "what", role: str | None = None,
                   roles: Sequence[str] | None = None, label_threshold: float = 2.7) -> DataFrame:
    """Minutes per activity (NA skipped, kept to 6 places) and their share of the
    total, 1 place; plus the chart columns: ``pct_label`` (text above the
    threshold), ``display_rank`` (order by share) and ``activity_total_min``
    (the title total, 1 place).

    Total, share and rank are windows over the aggregated categories only
    (one row per category per slice), so the log is scanned once.
    """
    agg, part = sliced(df, [key], _time_skipping_na, role, roles)
    agg = agg.withColumn("pct_time", round_to(grand_total_share(agg, "activity_time", part,
                                                                na="skip"), 1))
    total = F.sum("activity_time").over(Window.partitionBy(*part))
    rank_w = Window.partitionBy(*part).orderBy(F.col("pct_time").desc_nulls_last(),
                                               F.col(key).asc_nulls_last())
    return agg.select(*part, key, round_to("activity_time", 6).alias("activity_time"), "pct_time",
                      pct_label("pct_time", label_threshold).alias("pct_label"),
                      F.row_number().over(rank_w).cast("bigint").alias("display_rank"),
                      round_to(total, 1).alias("activity_total_min"))


def subcategory_share(df: DataFrame, key: str = "what", sub: str = "subcategory",
                      digits: int = 0, role: str | None = None,
                      roles: Sequence[str] | None = None,
                      label_threshold: float | None = None) -> DataFrame:
    """Rows with a subcategory only; minutes per (activity, subcategory) and
    the share inside the activity (0 places half-even in the general
    section, 1 place in role slices), with the pie label (every slice, or
    only above ``label_threshold``)."""
    agg, part = sliced(where_has_subcategory(df, sub), [key, sub], _time_skipping_na, role, roles)
    share = grand_total_share(agg, "activity_time", [*part, key], na="skip")
    out = agg.select(*part, key, sub, round_to("activity_time", 6).alias("activity_time"),
                     round_to(share, digits).alias("pct_time"))
    return out.withColumn("pct_label", pct_label("pct_time", label_threshold))


# ---------------------------------------------------------------------------
# Tool time (A11, A12) and its long form (R1, R4)

# Tool flag -> output column -> heat-map label.
TOOLS = [("how_paper", "paper_time", "Paper Time"),
         ("how_desktop", "computer_time", "Computer Time"),
         ("how_mobile", "mobile_time", "Mobile Time"),
         ("how_phone", "phone_time", "Phone Time")]


def tool_time(df: DataFrame, key: str = "what", role: str | None = None,
              roles: Sequence[str] | None = None, tools=TOOLS, sort: bool = False) -> DataFrame:
    """Rows where a tool was used; per key the minutes with each tool
    (``sum(minutes * flag)``, NA skipped, 1 place) and all minutes.  A row
    using two tools counts for both, so the parts may exceed the total.
    ``sort`` puts the longest first within a slice."""
    x = F.col(ACT_MIN)

    def measures(m: Rows) -> list[Column]:
        sums = {out: x * F.col(flag) for flag, out, _ in tools} | {"total_time": x}
        return [round_to(F.coalesce(m.sum(v), F.lit(0.0)), 1).alias(n) for n, v in sums.items()]

    used = df.where(tool_used([flag for flag, _, _ in tools]))
    agg, part = sliced(used, [key], measures, role, roles)
    out = agg.select(*part, key, "total_time", *[out for _, out, _ in tools])
    return _longest_first(out, part, key) if sort else out


def _longest_first(df: DataFrame, part: Sequence[str], key: str) -> DataFrame:
    return sort_small(df, *[F.col(p).asc_nulls_last() for p in part],
                      F.col("total_time").desc_nulls_last(), F.col(key).asc_nulls_last())


def to_long(df: DataFrame, ids: Sequence[str], values: Mapping[str, str],
            name: str = "name", value: str = "minutes") -> DataFrame:
    """Wide -> long (``pivot_longer``) with heat-map cell columns:
    ``heat = log10(minutes + 1)`` and ``label`` = minutes to 1 place.
    ``values`` maps column -> the name it gets in the ``name`` column."""
    renamed = df.select(*ids, *[F.col(c).cast("double").alias(n) for c, n in values.items()])
    long = renamed.unpivot(list(ids), list(values.values()), name, value)
    return long.withColumns({"heat": round_to(heat(value), 6), "label": round_to(F.col(value), 1)})


def tool_long(tool_table: DataFrame, key: str = "what", tools=TOOLS) -> DataFrame:
    ids = [c for c in ("role_slice", key) if c in tool_table.columns]
    return to_long(tool_table, ids, {out: lab for _, out, lab in tools}, "tool", "minutes")


# ---------------------------------------------------------------------------
# Location summary (A13, A14), matrix (A15, A16) and long form

def location_summary(df: DataFrame, key: str = "location", item: str = "what",
                     order: str = "sorted", role: str | None = None,
                     roles: Sequence[str] | None = None,
                     approx_distinct: bool = False) -> DataFrame:
    """Per location: distinct sessions, minutes (NA if any, 2 places) and
    the distinct activities seen there as one text (NA shown as ``NA``).

    ``order="sorted"`` lists activities alphabetically; ``order="first"``
    in order of first appearance (by ``activity_id``), which needs a
    (location, activity) pre-aggregate and then one small list per
    location -- bounded by the number of activity categories.
    """
    label = F.coalesce(F.col(item), F.lit("NA"))

    def measures(m: Rows) -> list[Column]:
        out = [m.distinct(SESSION, approx_distinct).alias("n_sessions"),
               round_to(sum_of(m, F.col(ACT_MIN)), 2).alias("total_time_min")]
        if order == "sorted":
            out.append(F.array_join(m.items(label, "__item"), ", ").alias("activities_list"))
        return out

    agg, part = sliced(df, [key], measures, role, roles)
    if order != "sorted":
        firsts, _ = sliced(df.withColumn("__item", label), [key, "__item"],
                           lambda m: [m.min(F.col("activity_id")).alias("__first")], role, roles)
        lists = (firsts.groupBy(*part, key)
                 .agg(F.array_sort(F.collect_list(F.struct("__first", "__item"))).alias("__l"))
                 .select(*part, key,
                         F.array_join(F.transform("__l", lambda s: s["__item"]), ", ")
                         .alias("activities_list")))
        # NULL location / role are real groups: join null-safe on the keys
        a, b = agg.alias("a"), lists.alias("b")
        cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*part, key]]
        agg = a.join(b, cond, "left").select(*[F.col(f"a.{c}") for c in agg.columns],
                                             F.col("b.activities_list"))
    return sort_small(agg.select(*part, key, "n_sessions", "total_time_min", "activities_list"),
                      *[F.col(p).asc_nulls_last() for p in part],
                      F.col("total_time_min").desc_nulls_last(), F.col(key).asc_nulls_last())


def location_matrix(df: DataFrame, locations: Sequence[tuple[str, str]], key: str = "what",
                    where: str = "location", role: str | None = None,
                    roles: Sequence[str] | None = None,
                    show: Sequence[str] | None = None,
                    hidden: Mapping[str, Sequence[str]] | None = None,
                    sort: bool = False) -> DataFrame:
    """Per activity: row count, minutes (1 place) and one column per listed
    location with the minutes spent there (1 place, 0 when none).

    ``locations`` is ``[(column, location value), ...]`` -- a parameter,
    so no job is spent discovering pivot values and the output schema is
    fixed.  ``show`` keeps a subset of location columns (presentation);
    ``hidden`` names, per role slice, columns that are not shown there (NULL).
    ``sort`` puts the longest first within a slice.
    """
    x = F.col(ACT_MIN)

    def measures(m: Rows) -> list[Column]:
        sums = {"total_time": x} | {c: F.when(F.col(where) == F.lit(v), x) for c, v in locations}
        return [m.n().alias("n_act"), *(round_to(F.coalesce(m.sum(v), F.lit(0.0)), 1).alias(n)
                                        for n, v in sums.items())]

    agg, part = sliced(df, [key], measures, role, roles)
    cols = [c for c, _ in locations] if show is None else list(show)
    shown = [F.when(~F.coalesce(F.col("role_slice").isin(
        [s for s, away in hidden.items() if c in away]), F.lit(False)), F.col(c)).alias(c)
        if part and hidden and any(c in away for away in hidden.values()) else F.col(c) for c in cols]
    out = agg.select(*part, key, "total_time", "n_act", *shown)
    return _longest_first(out, part, key) if sort else out


def location_long(matrix: DataFrame, locations: Sequence[tuple[str, str]],
                  key: str = "what") -> DataFrame:
    """Long form of the matrix's columns among ``locations``; cells that a
    slice does not show are left out."""
    ids = [c for c in ("role_slice", key) if c in matrix.columns]
    have = set(matrix.columns)
    long = to_long(matrix, ids, {c: c for c, _ in locations if c in have}, "location", "minutes")
    return long.where(F.col("minutes").isNotNull())


# ---------------------------------------------------------------------------
# Headcount (A17) and dataset overview (A18)

def headcount_by_role(df: DataFrame, role: str = "role",
                      keys: Sequence[str] = ("participant_id",),
                      labels: Mapping[str, str] | None = None,
                      prefix_others: str | None = None) -> DataFrame:
    """Distinct (keys, role) combinations counted per role, with report
    labels, most first (ties by role).  The hospital notebook counts distinct
    participants; the polyclinic one distinct (participant, session) pairs and
    prefixes unmapped roles with ``- ``."""
    counted = (df.select(*keys, role).distinct()
               .groupBy(role).agg(F.count(F.lit(1)).alias("count")))
    metric = label_roles(F.col(role), labels or {}, prefix_others)
    return sort_small(counted, F.col("count").desc_nulls_last(), F.col(role).asc_nulls_last()) \
        .select(metric.alias("metric"), "count")


OVERVIEW = [("Unique sessions", SESSION), ("Unique observers", "observer_id"),
            ("Unique HCWs", "participant_id")]


def dataset_overview(df: DataFrame, role: str | None = None,
                     head_keys: Sequence[str] = ("participant_id",),
                     labels: Mapping[str, str] | None = None, prefix_others: str | None = None,
                     approx_distinct: bool = False) -> DataFrame:
    """``(metric, count)`` rows: distinct sessions, observers and participants
    (NA counted as a value, 0 for an empty log), then with ``role`` the
    headcount rows (:func:`headcount_by_role`), most first.

    The log is read once, for the distinct tuples of all the ids involved
    (combined map-side); grouping sets over those give the distinct values of
    every metric, which are then counted.  ``approx_distinct`` counts the
    three ids by HyperLogLog++ sketches of the log instead.
    """
    ids = list(dict.fromkeys([c for _, c in OVERVIEW] + ([role, *head_keys] if role else [])))
    counted = [[role, *head_keys]] if role else []
    if not approx_distinct:
        counted += [[c] for _, c in OVERVIEW]
    long = None
    if counted:
        few = df.select(*ids).distinct()
        # which set a row is of: the headcount holds the role, the others one id
        which = F.lit(len(OVERVIEW)) if role else F.lit(None)
        for i, (_, c) in enumerate(OVERVIEW):
            which = F.when(F.grouping(c) == 0, i).otherwise(which)
        if role:
            which = F.when(F.grouping(role) == 0, len(OVERVIEW)).otherwise(which)
        values = few.groupingSets(counted, *ids).agg(which.alias("__set"))
        held = F.col(role) if role else F.lit(None).cast("string")
        none = df.sparkSession.createDataFrame(
            [(i, 0) for i in range(0 if approx_distinct else len(OVERVIEW))], "__set int, __n long")
        long = (values.select("__set", held.alias("__role"), F.lit(1).cast("bigint").alias("__n"))
                .unionByName(none, allowMissingColumns=True)
                .groupBy("__set", "__role").agg(F.sum("__n").alias("count")))
    if approx_distinct:
        sketched = df.agg(*[n_distinct(c, True).alias(f"n{i}") for i, (_, c) in enumerate(OVERVIEW)])
        rows = sketched.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("__set"), F.lit(None).cast("string").alias("__role"),
                     F.coalesce(f"n{i}", F.lit(0)).cast("bigint").alias("count"))
            for i in range(len(OVERVIEW))])))
        long = rows if long is None else long.unionByName(rows)
    metric = label_roles(F.col("__role"), labels or {}, prefix_others)
    for i, (name, _) in enumerate(OVERVIEW):
        metric = F.when(F.col("__set") == i, F.lit(name)).otherwise(metric)
    by_count = F.when(F.col("__set") == len(OVERVIEW), F.col("count"))
    return sort_small(long, F.col("__set").asc(), by_count.desc_nulls_last(),
                      F.col("__role").asc_nulls_last()).select(metric.alias("metric"), "count")
