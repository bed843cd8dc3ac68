"""Activity logs and lookups derived by Spark from the shared test tables.

The reference's raw exports are not public, so the driver's checks run on
an activity log that Spark derives from ``events`` (one event = one
observed activity) and ``customer`` (roles), and the bench on one derived
from ``lineitem`` (one order = one session).  Both are plain projections,
one aggregate and one join, so their cost grows with the tables.

``events`` mapping, with ``k`` the number in ``props``:

* ``session_id = user_id * 100 + day(ts)``, ``observer_id = user_id % 7``
* ``participant_id`` NULL when ``user_id % 11 = 0``, else ``'P' || user_id % 40``
* ``task_id = observer_session_eventid``; ``'x'`` (no trailing number) when ``k = 99``
* ``start_sec`` = seconds of day of ``ts``; ``active_sec = round(value * 60)``;
  ``end_sec = start + active`` (may pass 24 h)
* ``total_sec = active_sec``, NULL when ``k = 98`` and ``user_id % 7 = 3``
* ``session_start_sec / session_end_sec`` = min start / max end per session
* ``what = event_type``; ``subcategory = '0'`` when ``k % 5 = 0`` else ``'S' || k % 5``
* ``location`` by ``k % 6`` (five names, NULL for 5)
* ``how_*`` = bits 0..3 of ``k``; ``with_*`` = ``k`` divisible by 2, 3, 5, 7,
  11, 13, 17, 19 (``with_doctor`` NULL when ``k = 97``)
* ``comments = 'c' || k`` when ``k % 9 = 0``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlog.operators.joins import join_back

# Location names used for k % 6 = 0..4 (5 -> NULL).
EVENT_LOCATIONS = ["Corridors", "Workstation", "Treatment Room", "Waiting Area", "Other"]

# Divisor of k that sets each with-whom flag.
WITH_DIVISORS = [("with_doctor", 2), ("with_nurse", 3), ("with_clerk", 5), ("with_prr", 7),
                 ("with_patient", 11), ("with_relative", 13), ("with_ahp", 17),
                 ("with_other", 19)]
HOW_BITS = [("how_paper", 1), ("how_desktop", 2), ("how_mobile", 4), ("how_phone", 8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition a scan that yields fewer splits than the
    cluster has task slots (a file written as one row group is read by one
    task).  At scale a scan has far more splits than slots and this is a
    no-op, so no shuffle is added where it is not needed."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a Connect session)
        return df
    return df.repartition(slots) if splits < slots else df


def _session_bounds(df: DataFrame) -> DataFrame:
    """Attach min start / max end per session (aggregate combined map-side,
    then a skew-safe join back)."""
    bounds = (df.groupBy("session_id")
              .agg(F.min("start_sec").alias("session_start_sec"),
                   F.max("end_sec").alias("session_end_sec"),
                   F.count(F.lit(1)).alias("__rows")))
    return join_back(df, bounds, ["session_id"])


LOG_COLUMNS = ["activity_id", "observer_id", "session_id", "task_id", "participant_id",
               "session_date", "session_start_sec", "session_end_sec", "start_sec",
               "end_sec", "total_sec", "active_sec", "what", "subcategory", "location",
               "comments"] + [c for c, _ in WITH_DIVISORS] + [c for c, _ in HOW_BITS]


def activity_log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.regexp_extract("props", r"(\d+)", 1).try_cast("int").alias("k"))
    k = F.col("k")
    uid = F.col("user_id")
    start = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("bigint")
    active = F.round(F.col("value") * 60).cast("bigint")
    loc = None
    for i, name in enumerate(EVENT_LOCATIONS):
        cond = (k % 6) == i
        loc = F.when(cond, F.lit(name)) if loc is None else loc.when(cond, F.lit(name))
    withs = []
    for c, d in WITH_DIVISORS:
        e = F.when((k % d) == 0, 1).otherwise(0)
        if c == "with_doctor":
            e = F.when(k == 97, F.lit(None).cast("int")).otherwise(e)
        withs.append(e.cast("int").alias(c))
    hows = [F.when((k % (2 * b)) >= b, 1).otherwise(0).cast("int").alias(c) for c, b in HOW_BITS]
    base = ev.select(
        F.col("event_id").alias("activity_id"),
        (uid % 7).alias("observer_id"),
        (uid * 100 + F.dayofmonth("ts")).cast("bigint").alias("session_id"),
        F.when(uid % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("P"), (uid % 40).cast("string"))).alias("participant_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("session_date"),
        start.alias("start_sec"),
        (start + active).alias("end_sec"),
        F.when((k == 98) & (uid % 7 == 3), F.lit(None).cast("bigint"))
         .otherwise(active).alias("total_sec"),
        active.alias("active_sec"),
        F.col("event_type").alias("what"),
        F.when(k % 5 == 0, F.lit("0")).otherwise(F.concat(F.lit("S"), (k % 5).cast("string")))
         .alias("subcategory"),
        loc.alias("location"),
        F.when(k % 9 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("comments"),
        k, *withs, *hows)
    base = base.withColumn(
        "task_id",
        F.when(k == 99, F.lit("x")).otherwise(
            F.concat_ws("_", F.col("observer_id").cast("string"),
                        F.col("session_id").cast("string"),
                        F.col("activity_id").cast("string"))))
    return _session_bounds(base).select(*LOG_COLUMNS)


def by_day(cust: DataFrame, *cols) -> DataFrame:
    """``cols`` of every customer for each of 31 days (``day``), as a lookup
    to join.  Spark's estimate of its size does not see the explode and is 31
    times too small, so joins with it are shuffle joins: a broadcast chosen by
    that estimate would take the whole lookup through the driver."""
    days = F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day")
    return cust.select(*cols, days).hint("merge")


def role_lookup_from_customer(spark: SparkSession, sf_dir: str,
                              role_expr=None, where=None) -> DataFrame:
    """Role lookup keyed by ``session_id``: one row per customer with a
    positive balance and day 1..31 (``session_id = custkey * 100 + day``).

    Columns mirror the reference's hospital lookup: a work id, the session
    key, a numeric code and the role text.
    """
    cust = table(spark, sf_dir, "customer")
    cond = F.col("c_acctbal") > 0
    if where is not None:
        cond = cond & where
    role = F.col("c_mktsegment") if role_expr is None else role_expr
    return (by_day(cust.where(cond), F.col("c_name").alias("healthcare_work_id"),
                   F.col("c_custkey"), F.col("c_nationkey").cast("int").alias("role_code"),
                   role.alias("role"))
            .select("healthcare_work_id",
                    (F.col("c_custkey") * 100 + F.col("day")).cast("bigint").alias("session_id"),
                    "role_code", "role"))


def participant_lookup_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polyclinic-style lookup: ``session_id``, ``participant_id_2``
    (customer name when the balance exceeds 5000, else NULL) and role."""
    cust = table(spark, sf_dir, "customer")
    return (by_day(cust.where(F.col("c_acctbal") > 0),
                   F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("participant_id_2"),
                   "c_custkey", F.col("c_mktsegment").alias("role"))
            .select((F.col("c_custkey") * 100 + F.col("day")).cast("bigint").alias("session_id"),
                    "participant_id_2", "role"))


# ---------------------------------------------------------------------------
# lineitem-derived log (bench scale: 600k rows at sf0.1)

# Names for l_linestatus / l_returnflag in the bench log.
LINE_WHAT = {"A": "Direct Care", "N": "Indirect Care", "R": "Waiting Time"}
LINE_WHERE = {"O": "Treatment Room", "F": "Corridors"}


def activity_log_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench log: session = order, activity = line item, minutes = quantity,
    category = return flag, location = line status."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus", "l_shipdate")
    p = F.col("l_partkey")
    start = (F.col("l_linenumber") * 900 + (p % 600)).cast("bigint")
    active = (F.col("l_quantity") * 60).cast("bigint")
    what = F.create_map(*[F.lit(x) for kv in LINE_WHAT.items() for x in kv])[F.col("l_returnflag")]
    where = F.create_map(*[F.lit(x) for kv in LINE_WHERE.items() for x in kv])[F.col("l_linestatus")]
    withs = [F.when((p % d) == 0, 1).otherwise(0).cast("int").alias(c) for c, d in WITH_DIVISORS]
    hows = [F.when((p % (2 * b)) >= b, 1).otherwise(0).cast("int").alias(c) for c, b in HOW_BITS]
    base = li.select(
        F.monotonically_increasing_id().alias("activity_id"),
        (F.col("l_suppkey") % 50).alias("observer_id"),
        F.col("l_orderkey").alias("session_id"),
        F.concat_ws("_", (F.col("l_suppkey") % 50).cast("string"),
                    F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("task_id"),
        F.concat(F.lit("C"), (p % 1000).cast("string")).alias("participant_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("session_date"),
        start.alias("start_sec"), (start + active).alias("end_sec"),
        active.alias("total_sec"), active.alias("active_sec"),
        what.alias("what"),
        F.when(p % 4 == 0, F.lit("0")).otherwise(F.concat(F.lit("S"), (p % 4).cast("string")))
         .alias("subcategory"),
        where.alias("location"), F.lit(None).cast("string").alias("comments"),
        *withs, *hows)
    return _session_bounds(base).select(*LOG_COLUMNS)


def role_lookup_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench lookup keyed by order (= session): role = order priority.
    It grows with the data, so joins to it must not assume it is small."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("healthcare_work_id"),
        F.col("o_orderkey").alias("session_id"),
        F.lit(0).cast("int").alias("role_code"),
        F.col("o_orderpriority").alias("role"))
