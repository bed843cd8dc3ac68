"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
computed over the whole test tables (the activity log Spark derives from
``events`` + ``customer``; see :mod:`shiftlog.sources.testlog`).

The round-trip queries write through the real sinks into the session's
shared scratch folder and read back through the real scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlog.functions.rounding import round_columns

from shiftlog.operators import breakdowns as B
from shiftlog.operators import summaries as S
from shiftlog.operators.cleaning import (CORRECTION_SCHEMA, CorrectionTable, select_renamed,
                                         slice_by, union_all)
from shiftlog.operators.enrich import renumber_tasks, session_relative_time
from shiftlog.operators.joins import attach_role, prefer_lookup
from shiftlog.plans.cleaning import Export, clean_log, clean_polyclinic_log
from shiftlog.plans.reports import overview_bundle, patient_bundle, staff_bundle, write_bundle
from shiftlog.plans.sites import (EVENT_CLERK_OVERVIEW, EVENT_LOCATION_COLUMNS, EVENT_OVERVIEW,
                                  EVENT_ROLE_LABELS, EVENTS, EVENTS_CLERK, EVENTS_NOTEBOOK,
                                  EVENTS_PATIENT, EVENTS_POLYCLINIC)
from shiftlog.session import scratch_dir
from shiftlog.sources.forms import FORMS
from shiftlog.functions.labels import fold_flags
from shiftlog.sources.readers import read_activity_log, read_lookup
from shiftlog.sources.sinks import (read_report, report_catalog, stage, write_export,
                                    write_processed, write_report)
from shiftlog.sources.testlog import (LOG_COLUMNS, activity_log_from_events,
                                      participant_lookup_from_customer,
                                      role_lookup_from_customer)

Query = Callable[[SparkSession, str], DataFrame]

SESSION = S.SESSION
WAITING_VALUE = "view"          # the events log's "Waiting Time" category


def source_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_log_from_events(spark, sf_dir)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned events log: staged corrections, role join, recodes,
    exclusions, labels and session-relative times."""
    return clean_log([Export(source_log(spark, sf_dir))], EVENTS,
                     role_lookup_from_customer(spark, sf_dir))


def patient_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient-form view of the source log: no tool flags, and the
    ``No one`` flag where the staff form has ``Patient``."""
    return (source_log(spark, sf_dir)
            .drop("how_paper", "how_desktop", "how_mobile", "how_phone")
            .withColumnRenamed("with_patient", "with_no_one"))


def patient_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_log([Export(patient_source(spark, sf_dir))], EVENTS_PATIENT)


def clerk_lookups(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [role_lookup_from_customer(spark, sf_dir, where=F.col("c_nationkey") < 12),
            role_lookup_from_customer(
                spark, sf_dir,
                role_expr=F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))]


# ---------------------------------------------------------------------------
# Sources and sinks

def q_log_csv_roundtrip(spark, sf_dir):
    """Export the log as two CSV form versions (days 1-15 as v1, the rest
    as v2 with its own header names), scan both back, union by name."""
    return _through_exports(spark, source_log(spark, sf_dir))


def _early():
    """The first export's rows: days 1-15; the others are the second's."""
    return F.coalesce(F.dayofmonth(F.to_date("session_date")) <= 15, F.lit(False))


def _through_exports(spark, log):
    base = scratch_dir(spark, "log_csv")
    back = []
    for form, cond in (("staff_v1", _early()), ("staff_v2", ~_early())):
        write_export(log.where(cond), form, f"{base}/{form}")
        back.append(read_activity_log(spark, f"{base}/{form}", form, ordinal=False))
    cols = [c for c in LOG_COLUMNS if c != "activity_id"]
    return back[0].unionByName(back[1]).select(*cols)


def q_log_csv_quoted_roundtrip(spark, sf_dir):
    """The same with comments that hold quotes, separators and line breaks."""
    number = F.regexp_extract("comments", r"(\d+)", 1)
    said = F.concat(F.lit('said "'), "comments", F.lit('", then\nleft'))
    inch = F.concat(number, F.lit('"'))
    return _through_exports(spark, source_log(spark, sf_dir).withColumn(
        "comments", F.when(number % 2 == 0, said).when(number % 3 == 0, inch)
        .otherwise(F.col("comments"))))


def q_lookup_two_layouts(spark, sf_dir):
    """Two lookup files of other column order and number, read as one."""
    lk = role_lookup_from_customer(spark, sf_dir)
    base = scratch_dir(spark, "lookup_layouts")
    key, role = F.col("session_id").alias("session id"), F.col("role").alias("health_professional_desc")
    low = F.col("role_code") < 12
    for name, part in (("a", lk.where(low).select(key, role)),
                       ("b", lk.where(~low).select("healthcare_work_id", role, key))):
        part.write.option("header", True).option("sep", ";").csv(f"{base}/{name}")
    return read_lookup(spark, [f"{base}/a", f"{base}/b"])


def q_lookup_csv_roundtrip(spark, sf_dir):
    lk = role_lookup_from_customer(spark, sf_dir)
    path = scratch_dir(spark, "lookup_csv")
    (lk.select(F.col("healthcare_work_id").alias("healthcare_work_id_v2"),
               F.col("session_id").alias("session id"),
               F.col("role_code").alias("health_professional_v2"),
               F.col("role").alias("health_professional_desc"))
     .write.mode("overwrite").option("header", True).option("sep", ";").csv(path))
    return read_lookup(spark, path)


CATALOG = [
    ("observer_summary", "Per observer: sessions, activities per session, session minutes"),
    ("activity_summary", "Per activity: sessions, total, mean, max, min minutes and share"),
]


def q_report_bundle_roundtrip(spark, sf_dir):
    log = events_log(spark, sf_dir)
    bundle = {"report_summary": report_catalog(spark, CATALOG),
              "observer_summary": S.observer_summary(log),
              "activity_summary": S.activity_summary(log, sort=False)}
    paths = write_report(bundle, scratch_dir(spark, "report"))
    back = read_report(spark, paths)
    cat = back["report_summary"].where(F.col("sheet_name") == "activity_summary")
    # one catalog row: attached as a scalar subquery, not a join
    return back["activity_summary"].withColumn(
        "sheet_description", cat.select(F.max("description")).scalar())


def q_streaming_clean_log(spark, sf_dir):
    """Exports dropped in a folder (whole days per file, so sessions stay
    whole), cleaned by the streaming ingest, read back from its output."""
    from shiftlog.streaming.ingest import read_ingested, start_ingest
    base = scratch_dir(spark, "stream")
    write_export(source_log(spark, sf_dir).repartition("session_date"), "staff_v1",
                 f"{base}/inbox")
    q = start_ingest(spark, f"{base}/inbox", EVENTS, f"{base}/out", f"{base}/checkpoint",
                     lookups=role_lookup_from_customer(spark, sf_dir))
    q.awaitTermination()                   # availableNow: ends when the folder is drained
    if q.exception() is not None:
        raise RuntimeError(f"ingest failed: {q.exception()}")
    return read_ingested(spark, f"{base}/out").drop("activity_id", "batch_id")


def q_processed_log_roundtrip(spark, sf_dir):
    log = events_log(spark, sf_dir)
    path = write_processed(log, scratch_dir(spark, "processed"))
    return spark.read.schema(log.schema).parquet(path).select(*log.columns)


# ---------------------------------------------------------------------------
# Cleaning, joins, derived columns

def q_clean_log(spark, sf_dir):
    return events_log(spark, sf_dir)


def q_role_two_lookups(spark, sf_dir):
    return attach_role(source_log(spark, sf_dir), clerk_lookups(spark, sf_dir)) \
        .select("activity_id", "session_id", "role")


def q_patient_clean_log(spark, sf_dir):
    """Patient chain: fixes before the derived columns (a session ending
    past midnight), patient labels, a fix after normalisation."""
    return patient_log(spark, sf_dir)


def q_patient_provider_contact_time(spark, sf_dir):
    return S.provider_contact_time(patient_log(spark, sf_dir))


def q_clerk_clean_log(spark, sf_dir):
    """Clerk chain: clerk flags, two role lookups (first non-NULL wins),
    notebook labels."""
    drop = ["with_clerk", "with_prr"]
    return clean_log([Export(source_log(spark, sf_dir).drop(*drop))], EVENTS_CLERK,
                     clerk_lookups(spark, sf_dir))


def q_polyclinic_clean_log(spark, sf_dir):
    """Polyclinic chain: own exclusions, participant taken from the lookup
    when it has one."""
    return clean_polyclinic_log([Export(source_log(spark, sf_dir))], EVENTS_POLYCLINIC,
                                participant_lookup_from_customer(spark, sf_dir))


def q_prefer_lookup_participant(spark, sf_dir):
    lk = participant_lookup_from_customer(spark, sf_dir)
    return prefer_lookup(source_log(spark, sf_dir), lk, "participant_id", "participant_id_2") \
        .select("activity_id", "session_id", "participant_id")


def q_with_whom_label(spark, sf_dir):
    f = FORMS["staff_v1"]
    return source_log(spark, sf_dir).select(
        "activity_id",
        fold_flags(f.with_flags).alias("with_whom"),
        fold_flags(f.with_flags, empty="No one").alias("with_whom_nb"))


def q_how_label(spark, sf_dir):
    f = FORMS["staff_v1"]
    return source_log(spark, sf_dir).select(
        "activity_id",
        fold_flags(f.how_flags).alias("how"),
        fold_flags(f.how_flags, empty="None").alias("how_nb"))


def q_session_relative_time(spark, sf_dir):
    return events_log(spark, sf_dir).select(
        "activity_id", "session_id", "start_norm_sec", "end_norm_sec",
        "start_norm_hms", "end_norm_hms")


def q_session_relative_time_clock(spark, sf_dir):
    """Reference grouping: origin per (session start, session end) pair."""
    return session_relative_time(source_log(spark, sf_dir),
                                 keys=("session_start_sec", "session_end_sec")) \
        .select("activity_id", "session_start_sec", "session_end_sec",
                "start_norm_sec", "end_norm_sec", "start_norm_hms", "end_norm_hms")


def q_time_slots(spark, sf_dir):
    return events_log(spark, sf_dir).select("session_id", "session_start_sec", "time_slot") \
        .distinct()


def q_task_order(spark, sf_dir):
    return events_log(spark, sf_dir).select("activity_id", "task_id", "task_order")


def q_renumber_tasks(spark, sf_dir):
    return renumber_tasks(events_log(spark, sf_dir)) \
        .select("activity_id", "session_id", "task_order")


def q_renumber_listed_sessions(spark, sf_dir):
    """The reference's form: a few sessions renumbered, the others kept."""
    return renumber_tasks(events_log(spark, sf_dir), [802, 902, 1101, 1203])


def q_clean_log_salted(spark, sf_dir):
    """The chain with sessions of more than five rows spread by a salt."""
    cfg = replace(EVENTS, salted=True, hot_rows=5)
    return clean_log([Export(source_log(spark, sf_dir))], cfg,
                     role_lookup_from_customer(spark, sf_dir))


def two_exports_log(spark, sf_dir):
    """Two exports of one site: the second has no raw corrections and keeps
    only rows of sessions with a role; rows in the order of the union."""
    src = source_log(spark, sf_dir)
    return clean_log([Export(src.where(_early())),
                      Export(src.where(~_early()), require_role=True, apply_raw=False)],
                     EVENTS, role_lookup_from_customer(spark, sf_dir))


def q_clean_log_two_exports(spark, sf_dir):
    return two_exports_log(spark, sf_dir)


def q_location_summary_first_two_exports(spark, sf_dir):
    return B.location_summary(two_exports_log(spark, sf_dir), order="first")


def q_clean_log_from_tables(spark, sf_dir):
    """Corrections and exclusions held as tables: the events site's own, a
    participant for every customer in debt (their sessions of the 15th), and
    without the sessions of one nation's customers on the 20th and the tasks
    commented ``c45``."""
    own = spark.createDataFrame(
        [(c.dataset, c.stage, i, c.match_column, str(c.match_value), c.target, str(c.new_value))
         for i, c in enumerate(EVENTS.corrections)], CORRECTION_SCHEMA)
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey") * 100
    named = cust.where("c_acctbal < 0").select(
        F.lit("events").alias("dataset"), F.lit("derived").alias("stage"),
        (F.col("c_custkey") + 100).cast("int").alias("seq"), F.lit("session_id").alias("match_column"),
        (key + 15).cast("string").alias("match_value"), F.lit("participant_id").alias("target"),
        F.col("c_name").alias("new_value"))
    steps = list(dict.fromkeys((c.stage, c.match_column, c.target) for c in EVENTS.corrections))
    sessions = cust.where("c_nationkey = 3").select((key + 20).alias("session_id")).union(
        spark.range(1).select(F.explode(F.array(*map(F.lit, EVENTS.exclude_sessions)))))
    tasks = source_log(spark, sf_dir).where("comments = 'c45'").select("task_id")
    cfg = replace(EVENTS, corrections=(), exclude_sessions=sessions, exclude_tasks=tasks,
                  correction_table=CorrectionTable(own.unionByName(named), steps, "events"))
    return clean_log([Export(source_log(spark, sf_dir))], cfg,
                     role_lookup_from_customer(spark, sf_dir))


def q_notebook_clean_log(spark, sf_dir):
    """The notebook's chain: labels for empty flags, listed sessions
    renumbered, no late fix."""
    return notebook_log(spark, sf_dir)


def notebook_log(spark, sf_dir):
    return clean_log([Export(source_log(spark, sf_dir))], EVENTS_NOTEBOOK,
                     role_lookup_from_customer(spark, sf_dir))


# ---------------------------------------------------------------------------
# Summaries

def q_observer_summary(spark, sf_dir):
    return S.observer_summary(events_log(spark, sf_dir))


def q_observer_summary_brief(spark, sf_dir):
    return S.observer_summary(events_log(spark, sf_dir), brief=True)


def q_activity_summary(spark, sf_dir):
    return S.activity_summary(events_log(spark, sf_dir))


def q_activity_summary_by_role(spark, sf_dir):
    return S.activity_summary(events_log(spark, sf_dir), per_session=True, role="role")


def q_waiting_time(spark, sf_dir):
    return S.waiting_time(events_log(spark, sf_dir), waiting_value=WAITING_VALUE)


def q_provider_contact_time(spark, sf_dir):
    return S.provider_contact_time(events_log(spark, sf_dir))


def q_session_times(spark, sf_dir):
    return S.session_times(events_log(spark, sf_dir))


def q_session_minutes(spark, sf_dir):
    return S.session_minutes(events_log(spark, sf_dir))


def q_session_detail(spark, sf_dir):
    return S.session_detail(events_log(spark, sf_dir))


# ---------------------------------------------------------------------------
# Breakdowns

def q_activity_share(spark, sf_dir):
    return B.activity_share(events_log(spark, sf_dir))


def q_activity_share_by_role(spark, sf_dir):
    return B.activity_share(events_log(spark, sf_dir), role="role")


def q_subcategory_share(spark, sf_dir):
    return B.subcategory_share(events_log(spark, sf_dir))


def q_subcategory_share_by_role(spark, sf_dir):
    return B.subcategory_share(events_log(spark, sf_dir), digits=1, role="role")


def q_tool_by_activity(spark, sf_dir):
    return B.tool_time(events_log(spark, sf_dir))


def q_tool_by_activity_by_role(spark, sf_dir):
    return B.tool_time(events_log(spark, sf_dir), role="role")


def q_tool_by_location(spark, sf_dir):
    return B.tool_time(events_log(spark, sf_dir), key="location")


def q_tool_by_location_by_role(spark, sf_dir):
    return B.tool_time(events_log(spark, sf_dir), key="location", role="role")


def q_location_summary_by_role(spark, sf_dir):
    return B.location_summary(events_log(spark, sf_dir), role="role")


def q_location_matrix_shown(spark, sf_dir):
    """Some columns of the matrix, one of them hidden in one role's slice."""
    return B.location_matrix(events_log(spark, sf_dir), EVENT_LOCATION_COLUMNS, role="role",
                             roles=["BUILDING", "AUTOMOBILE"], show=["corridors", "other"],
                             hidden={"AUTOMOBILE": ["other"]})


def q_role_slice_activity_share(spark, sf_dir):
    """One role's rows alone, its table renamed and its minutes rounded."""
    one = slice_by(events_log(spark, sf_dir), "role", "BUILDING")
    share = B.activity_share(one)
    return round_columns(select_renamed(share, {"activity": "what", "time_min": "activity_time",
                                                "share_min": "activity_total_min"}), "_min", 2)


def q_union_filling(spark, sf_dir):
    """Detail rows and a total that lacks their columns, as one table."""
    log = events_log(spark, sf_dir)
    detail = log.groupBy("what", "location").agg(F.count(F.lit(1)).alias("n"))
    return union_all([detail, log.agg(F.count(F.lit(1)).alias("n"))], fill_missing=True)


def q_report_row_order(spark, sf_dir):
    """Place and first column of every row of the sorted report tables."""
    log = events_log(spark, sf_dir)
    tables = {"activity_summary": (S.activity_summary(log), "what"),
              "location_summary": (B.location_summary(log), "location"),
              "tool_by_activity": (B.tool_time(log, sort=True), "what"),
              "location_matrix": (B.location_matrix(log, EVENT_LOCATION_COLUMNS, sort=True), "what"),
              "headcount_by_role": (B.headcount_by_role(log), "metric"),
              "dataset_overview": (B.dataset_overview(log, role="role"), "metric"),
              "waiting_time": (S.waiting_time(log, WAITING_VALUE, sort=True), SESSION),
              "provider_contact_time": (S.provider_contact_time(log, sort=True), SESSION)}
    out = None
    for name, (df, key) in tables.items():
        part = _placed(df.select(F.col(key).cast("string").alias("key"))) \
            .select(F.lit(name).alias("table_name"), "place", "key")
        out = part if out is None else out.unionByName(part)
    return out


def _placed(df):
    """``place`` of each row of a sorted table, from 1.  Rows are numbered
    within their partitions and written so; what the partitions before hold is
    added (one row per partition)."""
    at = stage(df.select("*", F.monotonically_increasing_id().alias("__at")),
               scratch_dir(df.sparkSession, "placed"))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
             .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")))
    within = F.col("__at") - F.shiftleft("__part", 33)
    return (at.withColumn("__part", part).join(sizes, "__part")
            .withColumn("place", F.col("__off") + within + 1).drop("__at", "__part", "__off"))


def q_tool_long(spark, sf_dir):
    return B.tool_long(B.tool_time(events_log(spark, sf_dir)))


def q_location_summary(spark, sf_dir):
    return B.location_summary(events_log(spark, sf_dir))


def q_location_summary_first(spark, sf_dir):
    return B.location_summary(events_log(spark, sf_dir), order="first")


def q_location_matrix(spark, sf_dir):
    return B.location_matrix(events_log(spark, sf_dir), EVENT_LOCATION_COLUMNS)


def q_location_matrix_by_role(spark, sf_dir):
    return B.location_matrix(events_log(spark, sf_dir), EVENT_LOCATION_COLUMNS, role="role")


def q_location_long(spark, sf_dir):
    m = B.location_matrix(events_log(spark, sf_dir), EVENT_LOCATION_COLUMNS)
    return B.location_long(m, EVENT_LOCATION_COLUMNS)


def q_headcount_by_role(spark, sf_dir):
    return B.headcount_by_role(events_log(spark, sf_dir), labels=EVENT_ROLE_LABELS)


def q_headcount_by_role_sessions(spark, sf_dir):
    return B.headcount_by_role(events_log(spark, sf_dir), keys=("participant_id", "session_id"),
                               labels=EVENT_ROLE_LABELS, prefix_others="- ")


def q_dataset_overview(spark, sf_dir):
    return B.dataset_overview(events_log(spark, sf_dir), role="role", labels=EVENT_ROLE_LABELS)


# ---------------------------------------------------------------------------
# Report bundles, as one table of lines

def _cell(name: str, kind: str):
    value = F.col(name)
    if kind == "double":
        value = value.cast("decimal(38,6)")
    return F.coalesce(value.cast("string"), F.lit("NA"))


def bundle_lines(spark, log, build) -> DataFrame:
    """Writes the bundle and reads every sheet back: (sheet, line), the line
    holding the cells in the order of their columns' names."""
    paths = write_bundle(log, build, scratch_dir(spark, "bundle"))
    sheets = read_report(spark, {k: v for k, v in paths.items() if k != "processed"})
    out = None
    for name, df in sheets.items():
        cells = [_cell(c, k) for c, k in sorted(df.dtypes)]
        part = df.select(F.lit(name).alias("sheet"), F.concat_ws("|", *cells).alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


def q_staff_bundle(spark, sf_dir):
    return bundle_lines(spark, events_log(spark, sf_dir), staff_bundle)


def q_clerk_bundle(spark, sf_dir):
    return bundle_lines(spark, q_clerk_clean_log(spark, sf_dir),
                        lambda log: staff_bundle(log, clerk=True))


def q_patient_bundle(spark, sf_dir):
    return bundle_lines(spark, patient_log(spark, sf_dir),
                        lambda log: patient_bundle(log, waiting_value=WAITING_VALUE))


def q_overview_bundle(spark, sf_dir):
    """The staff notebook's tables, all rows and two roles."""
    return bundle_lines(spark, notebook_log(spark, sf_dir),
                        lambda log: overview_bundle(log, EVENT_OVERVIEW))


def q_clerk_overview(spark, sf_dir):
    """The clerk notebook's tables: no slices, a heat map of some columns."""
    return bundle_lines(spark, q_clerk_clean_log(spark, sf_dir),
                        lambda log: overview_bundle(log, EVENT_CLERK_OVERVIEW))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
