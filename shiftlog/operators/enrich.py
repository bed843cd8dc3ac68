"""Derived columns: minutes, time slot, task order, labels, session-relative
time and task renumbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlog.functions.labels import fold_flags
from shiftlog.functions.timefmt import minutes, seconds_to_hms, time_slot, trailing_number
from shiftlog.operators.joins import HOT_ROWS, _null_safe_left, join_back


def derive_times(df: DataFrame) -> DataFrame:
    """``total_session_min`` (end - start), ``total_activity_min`` (active
    time), ``time_slot`` (of the session start) and ``task_order`` (number
    at the end of the task id).  One projection, no shuffle."""
    return df.withColumns({
        "total_session_min": minutes(F.col("session_end_sec") - F.col("session_start_sec")),
        "total_activity_min": minutes("active_sec"),
        "time_slot": time_slot("session_start_sec"),
        "task_order": trailing_number("task_id"),
    })


def add_labels(df: DataFrame, with_flags: Sequence[tuple[str, str]],
               how_flags: Sequence[tuple[str, str]] = (),
               empty_with: str | None = None, empty_how: str | None = None,
               no_one_flag: tuple[str, str] | None = None) -> DataFrame:
    """``with_whom`` / ``how`` text from the one-hot flags (flag order is
    label order).  ``empty_*`` is the label of a row with no flag set:
    NULL in the scripts, ``"No one"`` / ``"None"`` in the notebooks."""
    cols = {"with_whom": fold_flags(with_flags, empty=empty_with, tail=no_one_flag)}
    if how_flags:
        cols["how"] = fold_flags(how_flags, empty=empty_how)
    return df.withColumns(cols)


def relative_to(df: DataFrame, origin: str, hms: bool = True) -> DataFrame:
    """Start / end of each activity relative to the seconds in ``origin``,
    which is dropped; with ``hms`` also as text."""
    out = df.withColumns({
        "start_norm_sec": F.col("start_sec") - F.col(origin),
        "end_norm_sec": F.col("end_sec") - F.col(origin),
    }).drop(origin)
    if not hms:
        return out
    return out.withColumns({"start_norm_hms": seconds_to_hms("start_norm_sec"),
                            "end_norm_hms": seconds_to_hms("end_norm_sec")})


def session_relative_time(df: DataFrame, keys: Sequence[str] = ("session_id",),
                          hms: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Start / end of each activity relative to the first activity start of
    its session.

    ``keys`` defaults to the session id; the reference groups by the
    (session start, session end) clock pair, available as
    ``keys=("session_start_sec", "session_end_sec")``.  The origin is an
    aggregate (combined map-side) joined back on the keys rather than a
    window, and the join back is skew-safe (:func:`join_back`): a session
    holding a large share of all rows gets its origin by broadcast and its
    rows are spread over many tasks, instead of one task sorting a huge
    window partition.
    """
    keys = list(keys)
    origin = df.groupBy(*keys).agg(F.min("start_sec").alias("__origin"),
                                   F.count(F.lit(1)).alias("__rows"))
    return relative_to(join_back(df, origin, keys, hot_rows=hot_rows), "__origin", hms)


def renumber_tasks(df: DataFrame, sessions: Sequence | None = None,
                   order_by: Sequence[str] = ("activity_id",),
                   col: str = "task_order", piece_rows: int = 65_536) -> DataFrame:
    """Renumber ``task_order`` 1..n inside each session in row order.

    Row order is the ingest ordinal by default; ``order_by`` must be unique
    inside a session (a row that equals another in it gets that row's number).

    A session is cut into pieces by its order key: ``piece_rows`` consecutive
    ordinals make one piece (a first order key that is no integer leaves the
    session whole).  A piece is a function of the row alone, so nothing
    depends on how the log is partitioned.  Rows are numbered within their
    piece, and a running sum over the sizes of a session's pieces gives what
    is added.  Both use one shuffle on (session, piece).

    ``sessions`` limits it to the listed sessions (the reference fixes one);
    the other rows keep their number, but for those of a NULL session, which
    go, as in the reference's ``filter(!id == v)``.  Then only
    the listed sessions' ids and order keys are read and numbered, a filter
    that reaches the scan, and the log is rewritten in one pass: a join on
    (session, order key), unique keys, and a ``when``.
    """
    if sessions is not None:
        listed = F.col("session_id").isin(list(sessions))
        slim = (df.where(listed).select("session_id", *[F.col(c).alias(f"__o_{c}") for c in order_by])
                .distinct())
        numbers = renumber_tasks(slim, None, [f"__o_{c}" for c in order_by], "__number", piece_rows)
        joined = _null_safe_left(df.where(F.col("session_id").isNotNull()), numbers, ["session_id", *order_by],
                                 renamed={c: f"__o_{c}" for c in order_by})
        value = F.when(listed, F.col("__number")).otherwise(F.col(col)) if col in df.columns \
            else F.col("__number")
        return joined.withColumn(col, value).drop("__number")
    kind = dict(df.dtypes)[order_by[0]]
    piece = (F.expr(f"`{order_by[0]}` div {int(piece_rows)}")
             if kind in ("tinyint", "smallint", "int", "bigint") else F.lit(0))
    # null keys are a session, and a first piece, of their own
    keyed = df.withColumns({
        "__null": F.col("session_id").isNull(),
        "__session": F.coalesce(F.col("session_id").cast("string"), F.lit("")),
        "__piece": F.coalesce(piece.cast("bigint"), F.lit(-2 ** 63))})
    at = ["__null", "__session", "__piece"]
    sizes = keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__null", "__session").orderBy("__piece") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*at, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = keyed.withColumn("__local", F.row_number().over(
        Window.partitionBy(*at).orderBy(*order_by)))
    return (local.join(offsets, at, "left")
            .withColumn(col, (F.col("__local") + F.col("__off")).cast("bigint"))
            .select(*df.columns, *([col] if col not in df.columns else [])))
