"""Report tables of the cleaning scripts: observer, activity, waiting,
provider-contact and session summaries.

Every operator aggregates first (Spark's partial/final hash aggregation,
so a hot key is combined map-side) and runs windows, shares and sorts only
on the aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlog.functions.aggregates import agg_sum
from shiftlog.functions.partials import Rows, all_present, mean_of, sliced, sum_of
from shiftlog.functions.rounding import round_to
from shiftlog.functions.timefmt import seconds_to_hms
from shiftlog.operators.joins import _null_safe_left

SESSION = "session_id"
ACT_MIN = "total_activity_min"


def sort_small(agg: DataFrame, *order) -> DataFrame:
    """Order a category-level aggregate (one row per activity, location,
    role slice -- tens of rows): it fits one task, so it is sorted there
    rather than through a sampled range shuffle.  Not for per-session
    tables, whose size grows with the data (those use ``orderBy``)."""
    return agg.coalesce(1).sortWithinPartitions(*order)


def grand_total_share(agg: DataFrame, value: str, part: Sequence[str] = (),
                      na: str = "propagate", total: str = "window") -> Column:
    """``100 * value / sum(value)`` over the aggregated rows (per ``part``).

    ``agg`` is an aggregate keyed by a category (activity, subcategory,
    location): its rows number the categories, not the data, so the total
    is a window over those rows and the data is scanned once.  For keys of
    unbounded cardinality pass ``total="subquery"``: the grand total is
    then an uncorrelated scalar subquery (a partial/final aggregate), at
    the price of a second scan of the aggregated columns.
    """
    v = F.col(value)
    if part or total == "window":
        w = Window.partitionBy(*part)
        if na == "propagate":
            tot = F.when(F.count(v).over(w) == F.count(F.lit(1)).over(w), F.sum(v).over(w))
        else:
            tot = F.sum(v).over(w)
    else:
        tot = agg.select(agg_sum(v, na=na)).scalar()
    return F.try_divide(v, tot) * F.lit(100.0)


# ---------------------------------------------------------------------------
# Observer summary (A1-A4)

def observer_summary(df: DataFrame, total_label: str = "Total", with_total: bool = True,
                     brief: bool = False, observer: str = "observer_id",
                     per: str = "row") -> DataFrame:
    """Per observer: distinct sessions, mean activities per session, mean
    session length (over activity rows), total activity minutes (NA if any
    is NA) and total time (seconds + ``HH:MM:SS``); plus a ``Total`` row
    whose total time skips NA.

    Plan: one shuffle of the raw log, already combined map-side, into
    (observer, session) partials; every per-observer measure is then a
    plain sum over those rows (a partial is unique per session, so counting
    sessions needs no distinct).  The ``Total`` row is summed from the
    per-observer rows; only its distinct-session count goes back to the
    partials, as one scalar subquery.  The rollup runs over the
    per-observer rows, so no ``Expand`` doubles the partials.  ``brief``
    returns the notebook's three measures
    (``avg_time_min``) without the total row.

    ``per="row"`` averages session length over activity rows, as the
    reference does (long sessions weigh more); ``per="session"`` averages
    it over sessions.
    """
    part = (df.groupBy(observer, SESSION).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_session_min").alias("s_tsm"), F.count("total_session_min").alias("c_tsm"),
        F.sum(ACT_MIN).alias("s_act"), F.count(ACT_MIN).alias("c_act"),
        F.sum("total_sec").alias("s_sec"), F.count("total_sec").alias("c_sec")))
    if per == "session":
        # one value per session: its mean over the session's rows
        part = part.withColumns({
            "s_tsm": F.try_divide(F.col("s_tsm"), F.col("c_tsm").cast("double")),
            "c_tsm": F.when(F.col("c_tsm") > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")})
    elif per != "row":
        raise ValueError("per must be 'row' or 'session'")
    keyed = F.col(SESSION).isNotNull()
    obs = part.groupBy(observer).agg(
        F.count(SESSION).alias("k_sess"),
        F.max(F.when(keyed, 0).otherwise(1)).alias("null_sess"),
        F.sum(F.when(keyed, F.col("n"))).alias("n_keyed"),
        *[F.sum(c).alias(c) for c in ("n", "s_tsm", "c_tsm", "s_act", "c_act", "s_sec", "c_sec")])

    def measures(k_sess, null_sess, n_keyed, n, s_tsm, c_tsm, s_act, c_act):
        return [
            (k_sess + null_sess).cast("bigint").alias("sessions"),
            round_to(F.try_divide(n_keyed.cast("double"), k_sess.cast("double")), 0)
            .alias("n_activities_avg"),
            round_to(F.try_divide(s_tsm, c_tsm.cast("double")), 2)
            .alias("avg_time_min" if brief else "avg_session_min"),
            round_to(F.when(c_act == n, s_act), 2).alias("total_time_min"),
        ]

    c = F.col
    if brief:
        return obs.select(c(observer), *measures(c("k_sess"), c("null_sess"), c("n_keyed"),
                                                  c("n"), c("s_tsm"), c("c_tsm"), c("s_act"),
                                                  c("c_act")))[
            [observer, "sessions", "n_activities_avg", "avg_time_min"]]
    if not with_total:
        per = obs.select(c(observer).cast("string").alias(observer),
                         *measures(c("k_sess"), c("null_sess"), c("n_keyed"), c("n"),
                                   c("s_tsm"), c("c_tsm"), c("s_act"), c("c_act")),
                         F.when(c("c_sec") == c("n"), c("s_sec")).alias("total_time_sec"))
    else:
        # rollup over the per-observer rows (one per observer): the Total row
        # comes from the same aggregate, so the log is shuffled once
        is_total = F.grouping(observer) == 1
        distinct_sessions = part.select(F.count_distinct(SESSION)).scalar()
        k_sess = F.when(is_total, distinct_sessions).otherwise(F.sum("k_sess"))
        per = obs.rollup(observer).agg(
            F.when(is_total, F.lit(total_label))
             .otherwise(c(observer).cast("string")).alias("__label"),
            *measures(k_sess, F.max("null_sess"), F.sum("n_keyed"), F.sum("n"),
                      F.sum("s_tsm"), F.sum("c_tsm"), F.sum("s_act"), F.sum("c_act")),
            F.when(is_total, F.coalesce(F.sum("s_sec"), F.lit(0)))
             .otherwise(F.when(F.sum("c_sec") == F.sum("n"), F.sum("s_sec")))
             .alias("total_time_sec"))
        per = per.drop(observer).withColumnRenamed("__label", observer)
    out = per.withColumn("total_time_hms", seconds_to_hms("total_time_sec"))
    return out.select(observer, "sessions", "n_activities_avg", "avg_session_min",
                      "total_time_min", "total_time_sec", "total_time_hms")


# ---------------------------------------------------------------------------
# Activity summary (A5, A6, A20)

MIN_COLS = ["total_time_min", "avg_time_min", "max_time_min", "min_time_min"]


def _activity_measures(m: Rows, per_session: bool, approx: bool) -> list[Column]:
    x = F.col(ACT_MIN)
    sessions = m.distinct(SESSION, approx)
    out = [sessions.alias("total_sessions")]
    if per_session:
        out.append(round_to(F.try_divide(m.n().cast("double"), sessions.cast("double")), 0)
                   .alias("avg_act_session"))
    present = all_present(m, x)
    return out + [sum_of(m, x).alias("total_time_min"), mean_of(m, x).alias("avg_time_min"),
                  F.when(present, m.max(x)).alias("max_time_min"),
                  F.when(present, m.min(x)).alias("min_time_min")]


def activity_summary(df: DataFrame, key: str = "what", per_session: bool = False,
                     role: str | None = None, roles: Sequence[str] | None = None,
                     all_label: str = "All", sort: bool = True,
                     approx_distinct: bool = False) -> DataFrame:
    """Per activity: sessions, total / mean / max / min minutes (NA if any
    input is NA), rounded to 2 places, then ``pct_time`` = share of the
    summed *rounded* totals, 1 place.  ``per_session`` adds the notebook's
    ``avg_act_session`` (rows per session, half-even to 0 places).

    With ``role`` set, one read of the log yields the all-roles table and one
    table per role, told apart by ``role_slice`` (``All`` vs the role; a true
    NULL role stays NULL): partial states per (role, activity, session) are
    merged by grouping sets.  ``roles`` keeps only the listed role slices
    besides ``All``.  ``approx_distinct`` counts sessions by HyperLogLog
    sketches (no shuffle of the distinct session ids; ~2% relative error).
    Ties of the sort follow the activity.
    """
    agg, part = sliced(df, [key], lambda m: _activity_measures(m, per_session, approx_distinct),
                       role, roles, all_label)
    agg = agg.withColumns({c: round_to(F.col(c), 2) for c in MIN_COLS})
    agg = agg.withColumn("pct_time", round_to(grand_total_share(agg, "total_time_min", part), 1))
    lead = part + [key, "total_sessions"] + (["avg_act_session"] if per_session else [])
    agg = agg.select(*lead, *MIN_COLS, "pct_time")
    if sort:
        agg = sort_small(agg, *[F.col(p).asc_nulls_last() for p in part],
                         F.col("total_time_min").desc_nulls_last(), F.col(key).asc_nulls_last())
    return agg


# ---------------------------------------------------------------------------
# Waiting time and provider contact per session (A9, A10)

def waiting_time(df: DataFrame, waiting_value: str = "Waiting Time", key: str = "what",
                 sort: bool = False) -> DataFrame:
    """Per session that has at least one waiting activity: waiting minutes,
    session minutes (both NA if any input is NA, rounded to 2) and
    ``waiting_pct`` = 100 * waiting / session from the rounded values.

    One ``groupBy(session)`` with conditional sums; equal to the
    reference's (session, activity) sums followed by a per-session total.
    ``sort=True`` orders by session (a global sort: a range shuffle of one
    row per session, so it is opt-in).
    """
    is_wait = F.coalesce(F.col(key) == F.lit(waiting_value), F.lit(False))
    x = F.col(ACT_MIN)
    agg = df.groupBy(SESSION).agg(
        F.count(F.when(is_wait, 1)).alias("__n"),
        F.when(F.count(F.when(is_wait, x)) == F.count(F.when(is_wait, 1)),
               F.sum(F.when(is_wait, x))).alias("waiting_time_min"),
        agg_sum(x).alias("total_session_min"))
    agg = agg.where(F.col("__n") > 0).withColumns({
        "waiting_time_min": round_to(F.col("waiting_time_min"), 2),
        "total_session_min": round_to(F.col("total_session_min"), 2),
    })
    pct = F.try_divide(F.col("waiting_time_min") * 100, F.col("total_session_min"))
    out = agg.select(SESSION, F.lit(waiting_value).alias(key), "waiting_time_min",
                     "total_session_min", round_to(pct, 2).alias("waiting_pct"))
    return out.orderBy(SESSION, F.col("waiting_time_min").desc_nulls_last()) if sort else out


def provider_contact_time(df: DataFrame, pattern: str = "Nurse|Doctor",
                          label: str = "with_whom", sort: bool = False) -> DataFrame:
    """Per session: minutes with a provider (companion label matching
    ``pattern``, case-insensitive), the session's minutes and the summed
    per-label percentages.  Every session of the log appears; sessions
    without provider contact get 0 everywhere (including the session
    minutes, as in the reference).

    Two aggregation levels: (session, label) sums, then one per-session
    pass over those rows (the label-level percentages need the rounded
    session total, a window over each session's few label rows).  The
    key-completion (right join to the session list + fill 0) is fused into
    the second pass, since every session already has label rows.
    """
    x = F.col(ACT_MIN)
    lab = (df.groupBy(SESSION, label).agg(agg_sum(x).alias("t")))
    w = Window.partitionBy(SESSION)
    tot = F.when(F.count("t").over(w) == F.count(F.lit(1)).over(w), F.sum("t").over(w))
    lab = lab.withColumns({"t": round_to(F.col("t"), 2), "tot": round_to(tot, 2)})
    hit = F.coalesce(F.col(label).rlike("(?i)" + pattern), F.lit(False))
    pct = round_to(F.try_divide(F.col("t") * 100, F.col("tot")), 2)
    lab = lab.withColumn("pct", pct)
    n_hit = F.count(F.when(hit, 1))

    def hit_sum(c: str) -> Column:
        return F.when(F.count(F.when(hit, F.col(c))) == n_hit, F.sum(F.when(hit, F.col(c))))

    out = lab.groupBy(SESSION).agg(
        round_to(hit_sum("t"), 2).alias("dr_nurse_min"),
        F.max(F.when(hit, F.col("tot"))).alias("total_session_min"),
        F.count(F.when(hit, F.col("tot"))).alias("__ntot"),
        round_to(hit_sum("pct"), 2).alias("dr_nurse_pct"),
        n_hit.alias("__nhit"))
    # a session whose provider rows have NA session minutes forms an NA group
    out = out.withColumn("total_session_min",
                         F.when(F.col("__ntot") == F.col("__nhit"), F.col("total_session_min")))
    out = out.select(SESSION, "dr_nurse_min", "total_session_min", "dr_nurse_pct")
    out = out.na.fill(0.0, subset=["dr_nurse_min", "total_session_min", "dr_nurse_pct"])
    return out.orderBy(SESSION, F.col("dr_nurse_min").desc()) if sort else out


# ---------------------------------------------------------------------------
# Session tables (D2, D3, W5)

SESSION_COLS = ["session_date", "observer_id", "time_slot", SESSION, "participant_id",
                "session_start_sec", "session_end_sec"]


def session_times(df: DataFrame, cols: Sequence[str] = SESSION_COLS) -> DataFrame:
    """Distinct session descriptions with the session's summed total time
    (NA if any activity's total time is NA), in seconds and ``HH:MM:SS``.

    The sum is per session id even when other columns vary inside a
    session.  Two aggregates, both combined map-side: the distinct
    descriptions, and the sum per session; the sums are joined to the
    descriptions null-safely.  No set of a session's descriptions is held
    anywhere, and either side of the join is an exchange, so the adaptive plan
    splits a session of very many descriptions over tasks.
    """
    per_session = df.groupBy(SESSION).agg(agg_sum("total_sec").cast("bigint")
                                          .alias("total_session_sec"))
    out = _null_safe_left(df.select(*cols).distinct(), per_session, [SESSION])
    return out.select(*cols, "total_session_sec",
                      seconds_to_hms("total_session_sec").alias("total_session_hms"))


def session_minutes(df: DataFrame, cols: Sequence[str] = SESSION_COLS) -> DataFrame:
    """Clerk variant: distinct session rows with the session length in
    minutes (end - start), rounded to 2."""
    return (df.select(*cols, round_to(F.col("total_session_min"), 2).alias("total_session_min"))
            .distinct())


DETAIL_COLS = [SESSION, "observer_id", "task_order", "what", "location", "with_whom", "how",
               "comments"]


def session_detail(df: DataFrame, cols: Sequence[str] = DETAIL_COLS) -> DataFrame:
    """Distinct activity rows: ids, order, labels, comments, minutes and
    seconds (both rounded to 2).  Patient logs pass ``cols`` without ``how``."""
    cols = [c for c in cols if c in df.columns]
    return (df.select(*cols,
                      round_to(F.col(ACT_MIN), 2).alias("total_activity_min"),
                      round_to(F.col(ACT_MIN) * 60, 2).alias("total_time_sec"))
            .distinct())
