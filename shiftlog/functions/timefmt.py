"""Clock and duration helpers.  Durations and clock times are LONG seconds.

Spark 4's TIME type is off by default, and clock values in the logs pass
24 h (a session ending at ``24:36:20``), so seconds are the carrier; text
is produced only for output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hms_to_seconds(text: ColumnOrName) -> Column:
    """``H:M:S`` text -> LONG seconds; hours may exceed 23; bad text -> NULL.

    Pure built-ins (``split`` + ``try_cast``), so it stays inside codegen
    and never throws under ANSI mode.
    """
    t = F.trim(_c(text))
    h = F.substring_index(t, ":", 1).try_cast("bigint")
    m = F.substring_index(F.substring_index(t, ":", 2), ":", -1).try_cast("bigint")
    s = F.floor(F.substring_index(t, ":", -1).try_cast("double")).cast("bigint")
    colons = F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))
    # exactly three numeric parts, minutes and seconds within a clock's
    # range; plain string functions, no regex and no array per value
    ok = (colons == 2) & (h >= 0) & m.between(0, 59) & s.between(0, 59)
    return F.when(ok, h * 3600 + m * 60 + s)


def seconds_to_hms(sec: ColumnOrName) -> Column:
    """LONG seconds -> ``HH:MM:SS`` text (hours keep growing past 24)."""
    s = _c(sec)
    sign = F.when(s < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(s)
    hours = F.floor(a / 3600).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")  # noqa: E731 - 0..59 only
    # built from lpad / concat (codegen'd) rather than a per-row formatter;
    # hours are never cut, they only get a leading zero below 10
    return F.concat(sign, F.when(F.length(hours) < 2, F.concat(F.lit("0"), hours))
                    .otherwise(hours),
                    F.lit(":"), two(F.floor((a % 3600) / 60)), F.lit(":"), two(a % 60))


def minutes(sec: ColumnOrName) -> Column:
    """Seconds -> DOUBLE minutes (``as.numeric(difftime)/60``)."""
    return _c(sec) / F.lit(60.0)


def clock_hour(sec: ColumnOrName) -> Column:
    """Hour of a clock value in seconds (``hour(hms)``)."""
    return F.floor(_c(sec) / 3600)


# The three named time slots and their inclusive hour ranges.
TIME_SLOTS = (("morning", 7, 11), ("afternoon", 12, 16), ("evening", 17, 20))
OTHER_SLOT = "other"


def time_slot(start_sec: ColumnOrName) -> Column:
    """Slot of a session start: morning 7-11, afternoon 12-16, evening
    17-20, anything else (including NULL) ``other``."""
    h = clock_hour(start_sec)
    out = None
    for name, lo, hi in TIME_SLOTS:
        cond = h.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(OTHER_SLOT))


def trailing_number(task_id: ColumnOrName) -> Column:
    """Number after the last ``_`` of a task id (``10175_10260_60`` -> 60);
    NULL when the id does not end in ``_<digits>``."""
    digits = F.regexp_extract(_c(task_id), r"_(\d+)$", 1)
    return F.when(digits != "", digits).try_cast("bigint")
