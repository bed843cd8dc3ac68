"""Rounding that gives the same digits in Spark and in a SQL oracle.

Raw binary doubles round differently across engines on ties.  Rounding the
value after a cast to DECIMAL(38, 6) is stable across engines; for zero
digits the reference's half-even rule is kept (``bround``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

ColumnOrName = Column | str

# DECIMAL(38, 6) holds totals up to 10^32 minutes, far past any log size.
_DEC = DecimalType(38, 6)


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x: ColumnOrName, digits: int) -> Column:
    """Round a DOUBLE to ``digits`` places; result is DOUBLE.

    The value is first fixed to 6 decimal places (absorbing float noise
    from summation order), then ``digits == 0`` rounds half to even (R's
    ``round(x)``) and ``digits >= 1`` rounds half up.
    """
    c = _c(x).cast(_DEC)
    if digits == 0:
        return F.bround(c, 0).cast("double")
    return F.round(c, digits).cast("double")


def round_columns(df, suffix: str = "_min", digits: int = 2, exclude=()):
    """``mutate(across(ends_with(suffix), round, digits))`` in one select."""
    return df.select(*[
        round_to(F.col(n), digits).alias(n)
        if n.endswith(suffix) and n not in exclude else F.col(n)
        for n in df.columns
    ])


def pct_text(pct: ColumnOrName) -> Column:
    """Number as R prints it: ``2.0`` -> ``2``, ``12.5`` -> ``12.5``."""
    return F.regexp_replace(_c(pct).cast("string"), r"\.0$", "")


def pct_label(pct: ColumnOrName, threshold: float | None = None) -> Column:
    """Chart label: ``'<pct>%'``; with a threshold only above it, else
    empty text."""
    c = _c(pct)
    text = F.concat(pct_text(c), F.lit("%"))
    if threshold is None:
        return text
    return F.when(c > F.lit(threshold), text).otherwise(F.lit(""))


def heat(minutes_col: ColumnOrName) -> Column:
    """Heat-map intensity ``log10(minutes + 1)``."""
    return F.log10(_c(minutes_col) + F.lit(1.0))
