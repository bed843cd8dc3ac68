"""One-hot flags -> readable label, and role labels for reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_flags(flags: Sequence[tuple[str, str]], empty: str | None = None,
               sep: str = ", ", tail: tuple[str, str] | None = None) -> Column:
    """Join the names of the set 0/1 flags in the given order.

    ``flags`` is ``[(column, label), ...]``.  A NULL flag counts as not set.
    ``empty`` is what a row with no flag set gets: NULL (script form),
    ``"No one"`` / ``"None"`` (notebook form) or ``""`` (patient form).
    ``tail`` is an extra ``(column, label)`` appended last; when it is set
    the joined text ends in that label without a separator (patient form's
    ``No one``, which the reference pastes without ``", "``).
    """
    # concat_ws skips NULL parts: one codegen'd expression, no array lambda
    body = F.concat_ws(sep, *[F.when(F.col(c) == 1, F.lit(label)) for c, label in flags])
    if tail is not None:
        tcol, tlabel = tail
        tail_txt = F.when(F.col(tcol) == 1, F.lit(tlabel)).otherwise(F.lit(""))
        # with the tail set, the separator after the body stays (", No one").
        body = F.when(F.col(tcol) == 1,
                      F.when(body == "", tail_txt)
                      .otherwise(F.concat(body, F.lit(sep), tail_txt))).otherwise(body)
    if empty is None:
        return F.when(body != "", body)
    return F.when(body == "", F.lit(empty)).otherwise(body)


def map_values(col: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Replace values found in ``mapping``; others keep ``default`` (the
    value itself when not given).  Compiled to a CASE chain."""
    out = None
    for old, new in mapping.items():
        cond = col == F.lit(old)
        out = F.when(cond, F.lit(new)) if out is None else out.when(cond, F.lit(new))
    fallback = col if default is None else default
    return fallback if out is None else out.otherwise(fallback)


def label_roles(col: Column, mapping: Mapping[str, str], prefix_others: str | None = None) -> Column:
    """Report label of a role.  Mapped roles get their label; others pass
    through, or get ``prefix_others`` in front (NULL shows as ``NA``)."""
    default = None
    if prefix_others is not None:
        default = F.concat(F.lit(prefix_others), F.coalesce(col, F.lit("NA")))
    return map_values(col, mapping, default)
