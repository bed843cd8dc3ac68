"""Whole-table checks on the sf0.001 test tables: invariants, plan shape,
and every registered query against its DuckDB oracle."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shiftlog.operators import breakdowns as B
from shiftlog.operators import summaries as S
from shiftlog.plans.registry import QUERIES, events_log
from shiftlog.plans.sites import EVENT_LOCATION_COLUMNS

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def log(spark):
    return events_log(spark, SF).cache()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def test_share_sums_to_100(log):
    pcts = [r.pct_time for r in S.activity_summary(log).collect()]
    assert abs(sum(pcts) - 100) <= 0.05 * len(pcts)
    for r in B.subcategory_share(log, digits=1).groupBy("what").agg(
            F.sum("pct_time").alias("s")).collect():
        assert abs(r.s - 100) <= 0.5


def test_matrix_columns_within_total(log):
    for r in B.location_matrix(log, EVENT_LOCATION_COLUMNS).collect():
        parts = sum(r[c] for c, _ in EVENT_LOCATION_COLUMNS)
        assert parts <= r.total_time + 0.05 * len(EVENT_LOCATION_COLUMNS)


def test_relative_time_starts_at_zero(log):
    mins = log.groupBy("session_id").agg(F.min("start_norm_sec").alias("m"))
    assert mins.where(F.col("m") != 0).count() == 0


def test_total_row_sums(log):
    rows = {r.observer_id: r for r in S.observer_summary(log).collect()}
    total = rows.pop("Total")
    known = [r.total_time_min for r in rows.values() if r.total_time_min is not None]
    if len(known) == len(rows):
        assert math.isclose(sum(known), total.total_time_min, abs_tol=0.01 * len(rows))


def test_provider_contact_has_every_session(log):
    assert S.provider_contact_time(log).count() == log.select("session_id").distinct().count()


def test_plans_stay_in_the_jvm_and_broadcast_lookups(spark, log):
    src = events_log(spark, SF)
    plan = _plan(src)
    assert "BroadcastHashJoin" in plan
    for fn in (S.observer_summary, S.activity_summary, B.activity_share, B.tool_time,
               S.provider_contact_time):
        p = _plan(fn(src))
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_exclusions_reach_the_scan(spark):
    src = events_log(spark, SF)
    plan = src._jdf.queryExecution().optimizedPlan().toString()
    # the exclusion predicate is folded below the projections onto the scan
    assert "1003" in plan and "Filter" in plan


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    s_idx = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    d_idx = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    got = sorted(tuple(_norm(r[i]) for i in s_idx) for r in df.collect())
    want = sorted(tuple(_norm(r[i]) for i in d_idx) for r in res.fetchall())
    assert got == want


def test_every_query_has_an_oracle():
    """The library's own queries; the training-data ones have tests of theirs."""
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())
    assert all(isinstance(sql, str) for sql in E.oracle_sql().values())


def test_report_bundles_write_and_read(spark, log, tmp_path):
    from shiftlog.plans.reports import (Overview, overview_bundle, patient_bundle, staff_bundle,
                                        write_bundle)
    from shiftlog.sources.sinks import read_report
    paths = write_bundle(events_log(spark, SF), staff_bundle, str(tmp_path / "staff"))
    back = read_report(spark, {k: v for k, v in paths.items() if k != "processed"})
    assert set(back) == {"report_summary", "observer_summary", "sessions_times",
                         "activity_summary", "session_detail"}
    assert back["report_summary"].count() == 4
    assert back["observer_summary"].where(F.col("observer_id") == "Total").count() == 1
    pat = patient_bundle(log, waiting_value="view")
    assert "how" not in pat["session_detail"].columns
    assert pat["with_dr_nurse_time"].count() == log.select("session_id").distinct().count()
    ov = overview_bundle(log, Overview(EVENT_LOCATION_COLUMNS, roles=["BUILDING"]))
    slices = {r.role_slice for r in ov["activity_summary"].select("role_slice").collect()}
    assert slices == {"All", "BUILDING"}
    assert ov["location_long"].count() == ov["location_matrix"].count() * 5
    clerk = overview_bundle(log, Overview(EVENT_LOCATION_COLUMNS, role=None))
    assert "role_slice" not in clerk["activity_share"].columns


PASS_THROUGH = ("ProjectExec", "FilterExec", "WholeStageCodegenExec", "InputAdapter",
                "ShuffleExchangeExec", "SortExec", "WindowExec", "UnionExec", "ExpandExec")
AGGREGATES = ("HashAggregateExec", "ObjectHashAggregateExec", "SortAggregateExec")


def _children(node):
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _single_partition_feeds(node, out):
    """Collect, for every SinglePartition exchange and every window without a
    partition spec, the first operator below it that is not a pass-through
    (it must be an aggregate, not a scan of raw rows)."""
    name = node.getClass().getSimpleName()
    single = (name == "ShuffleExchangeExec"
              and "SinglePartition" in node.outputPartitioning().toString())
    global_window = name == "WindowExec" and node.partitionSpec().isEmpty()
    if single or global_window:
        stack = _children(node)
        while stack:
            n = stack.pop()
            nm = n.getClass().getSimpleName()
            if nm in AGGREGATES:
                continue
            if nm in PASS_THROUGH:
                stack.extend(_children(n))
            else:
                out.append(nm)
    for c in _children(node):
        _single_partition_feeds(c, out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_single_partition_step_over_raw_rows(spark, name):
    if any(part in name for part in ("roundtrip", "streaming", "bundle", "clerk_overview",
                                     "report_row_order", "lookup_two_layouts")):
        pytest.skip("writes files while building the plan")
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    bad = []
    _single_partition_feeds(plan, bad)
    assert not bad, f"single-partition exchange fed by {bad}"
    text = plan.toString()
    for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
               "ArrowEvalPython", "PythonUDF"):
        assert op not in text, f"{name} plan contains {op}"


def _wide_exchanges(node, min_cols, out):
    """Shuffle exchanges that move rows at least ``min_cols`` columns wide
    (full log rows, as opposed to aggregates or lookups)."""
    if (node.getClass().getSimpleName() == "ShuffleExchangeExec"
            and node.output().size() >= min_cols):
        out.append(node.outputPartitioning().toString())
    for c in _children(node):
        _wide_exchanges(c, min_cols, out)


def _planned(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan


def _scans(node, path):
    """Scans of files under ``path``."""
    own = (node.getClass().getSimpleName() == "FileSourceScanExec"
           and path in node.toString())
    return own + sum(_scans(c, path) for c in _children(node))


@pytest.fixture
def stored_log(spark, tmp_path):
    from shiftlog.sources.testlog import activity_log_from_events
    path = str(tmp_path / "src")
    activity_log_from_events(spark, SF).write.parquet(path)
    return path


@pytest.fixture
def no_broadcast(spark):
    """Every join past its broadcast bound, as at scale."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("salted", [False, True])
def test_cleaning_shuffles_the_log_once_at_scale(spark, stored_log, no_broadcast, salted):
    """The log is shuffled once, for one join that brings role and origin, and
    read twice: for the rows and for one aggregate per session (a third time,
    one column, for the sessions to salt)."""
    import dataclasses
    from shiftlog.plans.cleaning import Export, clean_log
    from shiftlog.plans.sites import EVENTS
    from shiftlog.sources.testlog import role_lookup_from_customer
    df = clean_log([Export(spark.read.parquet(stored_log))],
                   dataclasses.replace(EVENTS, salted=salted),
                   role_lookup_from_customer(spark, SF))
    plan = _planned(df)
    wide = []
    _wide_exchanges(plan, 20, wide)
    assert len(wide) == 1 and ("__salt" in wide[0]) == salted, wide
    assert "SortMergeJoin" in plan.toString()
    # the salted form marks hot sessions on either side of the join
    assert _scans(plan, stored_log) == (4 if salted else 2)


def test_adaptive_plan_splits_a_hot_session(spark, no_broadcast, tmp_path):
    """A session of a third of all rows: its partition of the log is split by
    map output."""
    from shiftlog.plans.cleaning import CleaningConfig, Export, clean_log
    confs = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    log = events_log(spark, SF).limit(1).drop("role", *[c for c in events_log(spark, SF).columns
                                                        if c.endswith(("_min", "_hms")) or "norm" in c],
                                              "time_slot", "task_order", "with_whom", "how")
    path = str(tmp_path / "hot")
    n = F.col("n")
    (log.crossJoin(spark.range(30000, numPartitions=16).withColumnRenamed("id", "n"))
     .withColumn("session_id", F.when(n % 3 == 0, F.lit(5)).otherwise(n % 500 + 10).cast("bigint"))
     .withColumn("comments", F.sha2(n.cast("string"), 256)).drop("n").write.parquet(path))
    lk = spark.range(600).select(F.col("id").alias("session_id"),
                                 F.concat(F.lit("r"), F.col("id").cast("string")).alias("role"))
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        out = clean_log([Export(spark.read.parquet(path))], CleaningConfig(dataset="t"), lk)
        got = out.select("session_id", "role", "start_norm_sec").collect()
        assert len(got) == 30000 and sum(r["role"] == "r5" for r in got) == 10000
        ran = out.select("session_id", "role", "comments")
        ran.collect()
        assert "skew=true" in ran._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _expands_over_partials(node):
    """Grouping-set expansions, each with whether an aggregate lies below."""
    out = []
    if node.getClass().getSimpleName() == "ExpandExec":
        below, stack = False, _children(node)
        while stack:
            n = stack.pop()
            below = below or n.getClass().getSimpleName() in AGGREGATES
            stack += _children(n)
        out.append(below)
    for c in _children(node):
        out += _expands_over_partials(c)
    return out


@pytest.mark.parametrize("table", [
    lambda log: S.activity_summary(log, per_session=True, role="role"),
    lambda log: B.activity_share(log, role="role"),
    lambda log: B.subcategory_share(log, role="role"),
    lambda log: B.tool_time(log, role="role"), lambda log: B.tool_time(log, key="location", role="role"),
    lambda log: B.location_summary(log, role="role"),
    lambda log: B.location_matrix(log, EVENT_LOCATION_COLUMNS, role="role"),
    lambda log: B.dataset_overview(log, role="role"),
    lambda log: B.dataset_overview(log)])
def test_slices_expand_partial_states_of_one_scan(spark, tmp_path, log, table):
    path = str(tmp_path / "clean")
    log.limit(50).write.parquet(path)
    plan = _planned(table(spark.read.parquet(path)))
    expands = _expands_over_partials(plan)
    assert expands and all(expands)
    assert _scans(plan, path) == 1


def test_a_session_of_many_descriptions_is_split(spark, no_broadcast, tmp_path):
    """20,000 descriptions of one session: no set of them, and the adaptive
    plan splits the session over tasks."""
    confs = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    n = F.col("id")
    log = spark.range(30000, numPartitions=8).select(
        F.when(n < 20000, 7).otherwise(n % 300 + 10).cast("bigint").alias("session_id"),
        F.sha2(n.cast("string"), 256).alias("participant_id"), F.lit(2).cast("bigint").alias("total_sec"))
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        out = S.session_times(log, ["session_id", "participant_id"])
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 30000
    assert {r["total_session_sec"] for r in rows if r["session_id"] == 7} == {40000}
    assert "skew=true" in plan and "collect_set" not in plan


def test_listed_sessions_are_renumbered_beside_one_wide_scan(spark, tmp_path, log):
    from shiftlog.operators.enrich import renumber_tasks
    path = str(tmp_path / "clean")
    log.write.parquet(path)
    df = renumber_tasks(spark.read.parquet(path), [802, 902])
    plan = _planned(df)
    wide, narrow = [], []
    def walk(node):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            (wide if node.output().size() > 5 else narrow).append(node.toString())
        for c in _children(node):
            walk(c)
    walk(plan)
    assert len(wide) == 1 and len(narrow) == 2
    assert all("PushedFilters" in s and "In(session_id" in s for s in narrow)
