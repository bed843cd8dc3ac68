"""Lookup joins and skew-safe joins of per-key aggregates.

How a lookup is joined is left to Spark: statistics broadcast one that is known
to be small, and the adaptive plan one that turns out to be; else it is a
shuffle join whose skewed partitions the adaptive plan splits by map output, so
a key with a third of all rows is spread over many tasks, identical rows
included.

Where that cannot help (a join side that ends in an aggregate on the same keys,
adaptive execution off) keys holding more than ``HOT_ROWS`` rows ("hot": at most
rows / ``HOT_ROWS`` of them) can be salted: their rows get a salt
(:func:`add_salt`), and shuffle joins are keyed on (key, salt) with the other
side's hot rows copied per salt (:func:`salt_side`).  Which keys are hot reaches
the rows as a broadcast of at most ``MARK_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _left_join(log: DataFrame, small: DataFrame, key: str, null_safe: bool,
               hot: DataFrame | None = None) -> DataFrame:
    on = [key]
    if hot is not None and SALT in log.columns:
        small, on = salt_side(small, hot, [key]), [key, SALT]
    if not null_safe:
        return log.join(small, on, "left")
    # NULL key matches NULL key, as in the reference's joins
    return _null_safe_left(log, small, [key], on[1:])


def attach_role(log: DataFrame, lookups: DataFrame | Sequence[DataFrame],
                key: str = "session_id", value: str = "role", null_safe: bool = False,
                hot: DataFrame | None = None) -> DataFrame:
    """Left join the log to one or more ``(key, value)`` lookups.

    With several lookups the first non-NULL value wins, in list order (two
    chained left joins + ``coalesce``).  Lookup keys are expected unique (as
    the reference's lookups are); like a left join there, a repeated key
    repeats the log row.  ``null_safe=True`` also matches a NULL key to a
    NULL key (the reference's join semantics; SQL's ``=`` never does).
    With ``hot`` (see :func:`hot_keys`) and a salted log (:func:`add_salt`)
    the join is keyed on (key, salt).
    """
    if isinstance(lookups, DataFrame):
        lookups = [lookups]
    out = log.drop(value) if value in log.columns else log
    tmp = []
    for i, lk in enumerate(lookups):
        name = f"__{value}_{i}"
        small = lk.select(F.col(key), F.col(value).alias(name))
        out = _left_join(out, small, key, null_safe, hot)
        tmp.append(name)
    merged = F.coalesce(*[F.col(t) for t in tmp]) if len(tmp) > 1 else F.col(tmp[0])
    return out.withColumn(value, merged).drop(*tmp)


def prefer_lookup(log: DataFrame, lookup: DataFrame, target: str, source: str,
                  key: str = "session_id", carry: Sequence[str] = (),
                  hot: DataFrame | None = None, null_safe: bool = False) -> DataFrame:
    """``target := coalesce(lookup.source, log.target)`` via a left join;
    ``carry`` lookup columns (e.g. the role) come along in the same join."""
    small = lookup.select(F.col(key), F.col(source).alias("__src"), *carry)
    out = log.drop(*[c for c in carry if c in log.columns])
    out = _left_join(out, small, key, null_safe, hot)
    return out.withColumn(target, F.coalesce(F.col("__src"), F.col(target))).drop("__src")


# Keys with more rows than this are "hot": there are at most rows / HOT_ROWS
# of them, so their aggregate rows are a small table by construction.
HOT_ROWS = 2_000_000
HOT_SALTS = 64
SALT = "__salt"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than ``hot_rows`` rows of ``df`` -- at most
    ``len(df) / hot_rows`` of them, a small table by construction.  One
    partially aggregated count over the key columns."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
            .where(F.col("__rows") > hot_rows).select(*keys))


# Hot keys are marked by a bit of their hash, in this many words of 64 bits: what
# passes through the driver does not grow with the number of hot keys.
MARK_WORDS = 131_072


def _mark_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``__is_hot``: the row's key is hot, or NULL (NULL keys match
    nothing in an equi-join, so spreading them is free and keeps a mass of
    NULL keys out of one task).  A key whose hash shares its bit with a hot
    key's counts as hot: the mark is a function of the key, the same on both
    sides of a salted join, so such a key is spread as well and loses nothing."""
    kinds = dict(hot.dtypes)            # a lookup's int hashes as the log's bigint
    at = F.pmod(F.xxhash64(*[F.col(k).try_cast(kinds[k]) for k in keys]), F.lit(64 * MARK_WORDS))
    word, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    marks = hot.groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__marks"))
    marked = df.withColumn("__word", word).join(F.broadcast(marks), "__word", "left")
    is_hot = F.coalesce(F.getbit("__marks", bit) == 1, F.lit(False))
    for k in keys:
        is_hot = is_hot | F.col(k).isNull()
    return marked.withColumn("__is_hot", is_hot).drop("__word", "__marks")


def _row_salt(df: DataFrame, salts: int) -> Column:
    """1..``salts`` by a hash of the row and its partition: a task that runs
    again gives the same salts, and identical rows, which lie in many
    partitions, do not all get one."""
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns], F.spark_partition_id())
    return F.pmod(row_hash, F.lit(salts)) + 1


def add_salt(df: DataFrame, hot: DataFrame, keys: Sequence[str],
             salts: int = HOT_SALTS) -> DataFrame:
    """Rows of hot keys (as :func:`_mark_hot` marks them) get ``__salt``
    1..``salts``; all other rows get 0."""
    salt = _row_salt(df, salts)
    return (_mark_hot(df, hot, keys)
            .withColumn(SALT, F.when(F.col("__is_hot"), salt)
                        .otherwise(F.lit(0)).cast("bigint"))
            .drop("__is_hot"))


def salt_side(side: DataFrame, hot: DataFrame, keys: Sequence[str],
              salts: int = HOT_SALTS) -> DataFrame:
    """The other side of a salted join: each row once with salt 0, and rows
    of hot keys once more for every salt 1..``salts``.  A join compares text
    with other types as these ('007' is 7), which the text's hash does not
    show, so a side of another type than the text of ``hot`` has all its rows
    copied; copies of keys that are not hot match nothing."""
    zero = F.lit(0).cast("bigint")
    own, kinds = dict(side.dtypes), dict(hot.dtypes)
    untold = any(kinds[k] == "string" and own[k] != "string" for k in keys)
    copies = F.when(F.col("__is_hot") | F.lit(untold), F.sequence(zero, F.lit(salts).cast("bigint"))) \
        .otherwise(F.array(zero))
    return (_mark_hot(side, hot, keys)
            .select(*side.columns, F.explode(copies).alias(SALT)))


def _null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    extra: Sequence[str] = (), renamed: dict[str, str] | None = None) -> DataFrame:
    """``left LEFT JOIN right`` on ``keys`` (NULL matches NULL, as a
    grouping treats NULL as one group) and ``extra`` (plain equality);
    ``renamed`` says which keys have another name in ``right`` already."""
    given, renamed = renamed or {}, {c: f"__r_{c}" for c in [*keys, *extra]}
    r = right.withColumnsRenamed({given.get(c, c): new for c, new in renamed.items()})
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[renamed[k]])
        cond = c if cond is None else cond & c
    for e in extra:
        cond = cond & (left[e] == r[renamed[e]])
    return left.join(r, cond, "left").drop(*renamed.values())


def join_back(df: DataFrame, agg: DataFrame, keys: Sequence[str], rows_col: str = "__rows",
              hot_rows: int = HOT_ROWS, salts: int = HOT_SALTS) -> DataFrame:
    """``df LEFT JOIN agg USING keys`` for a per-key aggregate ``agg`` (one
    row per key, with its row count in ``rows_col``), safe when one key
    holds a large share of ``df``.  Keys match null-safely: a NULL key is
    a group of its own, as in the aggregate.

    A plain shuffle join would send every row of a hot key to one task, and
    Spark's adaptive skew split does not apply when one join side ends in an
    aggregate.  Instead:

    * hot keys (more than ``hot_rows`` rows; at most ``len(df) / hot_rows``
      of them) take their values from a broadcast of those few aggregate
      rows -- no shuffle;
    * their rows carry a salt 1..``salts``, so in the
      shuffle join that serves all other keys they spread over many tasks
      and match nothing;
    * all other rows (salt 0) join the aggregate normally.

    One scan of ``df``; the aggregate is computed once (its exchange is
    reused by both uses).
    """
    keys = list(keys)
    vals = [c for c in agg.columns if c not in keys and c != rows_col]
    hot_rows_agg = (agg.where(F.col(rows_col) > hot_rows)
                    .select(*keys, F.lit(True).alias("__is_hot"),
                            *[F.col(v).alias(f"__hot_{v}") for v in vals]))
    salt = _row_salt(df, salts)
    x = _null_safe_left(df, F.broadcast(hot_rows_agg), keys)
    x = x.withColumn("__salt", F.when(F.col("__is_hot"), salt).otherwise(F.lit(0))
                     .cast("bigint"))
    # salt 0 for the other keys, -1 (matched by nothing) for hot ones; taken
    # from the data so the optimizer cannot fold it out of the join keys
    cold_salt = F.when(F.col(rows_col) > hot_rows, F.lit(-1)).otherwise(F.lit(0))
    cold = agg.select(*keys, cold_salt.cast("bigint").alias("__salt"),
                      *[F.col(v).alias(f"__cold_{v}") for v in vals])
    out = _null_safe_left(x, cold, keys, ["__salt"])
    return out.select(*df.columns,
                      *[F.coalesce(F.col(f"__hot_{v}"), F.col(f"__cold_{v}")).alias(v)
                        for v in vals])


def complete_keys(agg: DataFrame, spine: DataFrame, key: str = "session_id",
                  fill=0) -> DataFrame:
    """Every key of ``spine`` appears once; keys missing from ``agg`` get
    ``fill`` in every other column (``right_join`` + ``replace_na``).
    Both sides are keyed aggregates, so this is a shuffle join on the key."""
    out = spine.select(key).distinct().join(agg, key, "left")
    return out.na.fill(fill, subset=[c for c in agg.columns if c != key])
