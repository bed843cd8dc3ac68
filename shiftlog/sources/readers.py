"""Typed scans of activity-log exports and role lookups (CSV)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shiftlog.functions.timefmt import hms_to_seconds, seconds_to_hms
from shiftlog.sources.forms import Form, get_form
from shiftlog.sources.records import Records, parse, read_records

_NO_RECORDS = ("file string, file_no int, line bigint, layout int, text string, "
               "torn boolean")


def _typed(raw: str, kind: str):
    c = F.col(f"`{raw}`")
    if kind == "hms":
        return hms_to_seconds(c)
    if kind == "long":
        return F.trim(c).try_cast("bigint")
    if kind == "int":
        return F.trim(c).try_cast("int")
    return c


# Canonical columns an export must have; the rest may be absent (NULL).
REQUIRED = ("observer_id", "session_id", "task_id", "session_start_sec", "session_end_sec",
            "start_sec", "end_sec", "active_sec", "what")


def read_activity_log(spark: SparkSession, path: str | Sequence[str], form: str | Form,
                      ordinal: bool = True, keep_unknown: bool = False,
                      bad: str = "fail", export: int = 0) -> DataFrame:
    """Scan one or many exports of one form into the canonical layout.

    Columns are matched by header name, as the reference's reader does, and
    every file by its own header: reordered columns are fine, absent optional
    columns come back NULL and a missing required column fails.  Fields in
    quotes may hold separators, doubled quotes and line breaks
    (:mod:`shiftlog.sources.records`); empty fields and ``NA`` are NULL.
    H:M:S columns become LONG seconds (values past 24 h are kept, text that
    does not parse becomes NULL).  ``path`` may be a folder, a glob or a
    list, so many exports of one layout load in parallel.

    ``bad="fail"`` raises at a record that has another number of fields than
    its header or is cut off inside quotes; ``bad="column"`` adds
    ``bad_record``: the text of such a record (its other columns are NULL)
    and of one with a value that its column's type does not take (that
    column is NULL), else NULL.

    ``ordinal`` adds ``activity_id``: it increases by file and line (the row
    order that the reference relies on) and differs between exports that are
    read with different ``export`` numbers.  ``keep_unknown`` passes columns
    the form does not know through as text.
    """
    if bad not in ("fail", "column"):
        raise ValueError(f"bad must be 'fail' or 'column', not {bad!r}")
    f = get_form(form) if isinstance(form, str) else form
    records = read_records(spark, path, torn="fail" if bad == "fail" else "keep")
    if records is None:  # no file holds a line
        records = Records(spark.createDataFrame([], _NO_RECORDS), [f.raw_names], ",")
    by_raw = {r: (canon, kind) for r, canon, kind in f.columns}
    for names in records.layouts:
        present = {by_raw[h][0] for h in names if h in by_raw}
        if missing := [c for c in REQUIRED if c not in present]:
            raise ValueError(f"an export of {path} lacks required columns {missing} "
                             f"for form {f.name!r}")
    known = [(r, canon, kind) for r, canon, kind in f.columns if canon not in f.dropped]
    extra = sorted({h for names in records.layouts for h in names if h not in by_raw})
    parsed = parse(records, [r for r, _, _ in known] + (extra if keep_unknown else []),
                   [records.ordinal(export).alias("activity_id")])
    if bad == "fail":
        parsed = _checked(parsed)
    else:  # a bad record's fields may have shifted
        texts = [c for c in parsed.columns if c not in ("activity_id", "text", "bad")]
        parsed = parsed.withColumns({c: F.when(~F.col("bad"), F.col(f"`{c}`")) for c in texts})
    cols = [_typed(r, kind).alias(canon) for r, canon, kind in known]
    if keep_unknown:
        cols += [F.col(f"`{h}`") for h in extra]
    if bad == "column":
        lost = F.col("bad")
        for r, _, kind in known:
            if kind != "string":
                lost = lost | (F.col(f"`{r}`").isNotNull() & _typed(r, kind).isNull())
        cols.append(F.when(lost, F.col("text")).alias("bad_record"))
    return parsed.select(*(["activity_id"] if ordinal else []), *cols)


def _checked(parsed: DataFrame) -> DataFrame:
    """Fails at a bad record, in a filter (which no later step prunes)."""
    stop = F.raise_error(F.concat(F.lit("not as many fields as the header: "),
                                  F.substring("text", 1, 200))).cast("boolean")
    return parsed.where(F.when(F.col("bad"), stop).otherwise(F.lit(True)))


def to_export(df: DataFrame, form: str | Form) -> DataFrame:
    """Canonical layout -> the form's raw header names and H:M:S text
    (the inverse of :func:`read_activity_log`; columns absent from ``df``
    are written empty)."""
    f = get_form(form) if isinstance(form, str) else form
    have = set(df.columns)
    out = []
    for r, canon, kind in f.columns:
        if canon not in have:
            out.append(F.lit(None).cast("string").alias(r))
        elif kind == "hms":
            out.append(seconds_to_hms(F.col(canon)).alias(r))
        else:
            out.append(F.col(canon).cast("string").alias(r))
    return df.select(*out)


LOOKUP_KEY = "session id"


def read_lookup(spark: SparkSession, path: str | Sequence[str],
                columns: dict[str, str] | None = None,
                key: str = LOOKUP_KEY, sep: str = ";") -> DataFrame:
    """Scan ``;``-separated lookups (UTF-8 BOM and CRLF allowed) and keep
    the key plus the wanted columns, renamed.

    ``columns`` maps lookup header -> output name; default keeps
    ``health_professional_desc`` as ``role``.  Every file is read by its own
    header, so files of other column order give all their rows; a file that
    lacks a column, or a record with another number of fields than its
    header, fails.  The key is LONG, empty fields and ``NA`` are NULL, and
    white space around fields is trimmed.
    """
    columns = columns or {"health_professional_desc": "role"}
    records = read_records(spark, path, sep)
    if records is None:
        records = Records(spark.createDataFrame([], _NO_RECORDS), [[key, *columns]], sep)
    for names in records.layouts:
        if missing := [c for c in [key, *columns] if c not in names]:
            raise ValueError(f"a lookup of {path} lacks columns {missing}; has {names}")
    parsed = _checked(parse(records, [key, *columns]))
    out = [F.trim(F.col(f"`{key}`")).try_cast(LongType()).alias("session_id")]
    out += [F.trim(F.col(f"`{src}`")).alias(dst) for src, dst in columns.items()]
    return parsed.select(*out)
