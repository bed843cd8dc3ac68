import pytest
from pyspark.sql import functions as F

from shiftlog.operators.cleaning import (Correction, apply_correction_table, apply_corrections,
                                         exclude_keys, recode, where_has_subcategory,
                                         where_matches, where_tool_used)
from shiftlog.operators.enrich import renumber_tasks, session_relative_time
from shiftlog.operators.joins import attach_role, complete_keys, prefer_lookup
from shiftlog.plans.cleaning import CleaningConfig, Export, clean_log
from shiftlog.plans.sites import STAFF_RECODES
from shiftlog.sources.readers import read_activity_log, read_lookup, to_export
from shiftlog.sources.sinks import report_catalog, write_processed, write_report, read_report
from tests.fixtures import lookup_csv, staff_csv


def _write(tmp_path, name, data):
    p = tmp_path / name
    (p.write_bytes if isinstance(data, bytes) else p.write_text)(data)
    return str(p)


def test_read_activity_log_types_and_edge_rows(spark, tmp_path):
    df = read_activity_log(spark, _write(tmp_path, "v1.csv", staff_csv()), "staff_v1")
    types = dict(df.dtypes)
    assert types["session_id"] == "bigint" and types["session_end_sec"] == "bigint"
    assert types["with_doctor"] == "int" and types["what"] == "string"
    rows = {r.task_id + str(r.activity_id): r for r in df.collect()}
    assert len(rows) == 6
    past = [r for r in rows.values() if r.session_id == 502][0]
    assert past.session_end_sec == 88580 and past.total_sec is None
    assert past.participant_id is None
    ids = sorted(r.activity_id for r in rows.values())
    assert ids == sorted(set(ids))            # ingest ordinal is unique


def test_v2_export_renamed_onto_v1_and_union(spark, tmp_path):
    v1 = read_activity_log(spark, _write(tmp_path, "a.csv", staff_csv("staff_v1")), "staff_v1")
    v2 = read_activity_log(spark, _write(tmp_path, "b.csv", staff_csv("staff_v2")), "staff_v2")
    assert "with_student" not in v2.columns and "int_task_id_1" not in v2.columns
    both = v1.unionByName(v2)
    assert both.count() == 12
    assert both.where(F.col("with_clerk") == 1).count() == 2


def test_export_round_trip(spark, tmp_path):
    df = read_activity_log(spark, _write(tmp_path, "a.csv", staff_csv()), "staff_v1", ordinal=False)
    out = str(tmp_path / "out")
    to_export(df, "staff_v1").write.option("header", True).csv(out)
    back = read_activity_log(spark, out, "staff_v1", ordinal=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_read_lookup_bom_crlf_trim(spark, tmp_path):
    lk = read_lookup(spark, _write(tmp_path, "lk.csv", lookup_csv()))
    assert lk.columns == ["session_id", "role"]
    got = sorted((r.session_id, r.role) for r in lk.collect())
    assert got == [(501, "Nurse"), (502, "Physician"), (504, None)]


def test_staged_corrections_merge_then_fix(spark):
    df = spark.createDataFrame([(10202, 1), (10203, 2), (10204, 3)], "session_id long, s long")
    fixes = [Correction("d", "raw", "session_id", 10202, "session_id", 10203),
             Correction("d", "raw", "session_id", "10203", "s", "99"),
             Correction("d", "late", "session_id", 10204, "s", 0),
             Correction("other", "raw", "session_id", 10204, "s", 7)]
    out = apply_corrections(df, fixes, "raw", "d")
    assert sorted(map(tuple, out.collect())) == [(10203, 99), (10203, 99), (10204, 3)]


def test_correction_table_join(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "session_id long, p string")
    table = spark.createDataFrame([(2, "B")], "session_id long, new_value string")
    got = sorted(map(tuple, apply_correction_table(df, table, "session_id", "p").collect()),
                 key=str)
    assert got == sorted([(1, "a"), (2, "B"), (None, "c")], key=str)


def test_exclude_keys_drops_null_like_reference(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "session_id long")
    assert [r[0] for r in exclude_keys(df, "session_id", [2]).collect()] == [1]
    keys = spark.createDataFrame([(2,)], "k long")
    assert [r[0] for r in exclude_keys(df, "session_id", keys).collect()] == [1]


def test_filters(spark):
    df = spark.createDataFrame(
        [("0", 0, 0, "Nurse"), ("Exam", 1, None, "doctor, Other"), (None, None, 1, None)],
        "subcategory string, how_paper int, how_phone int, with_whom string")
    assert where_has_subcategory(df).count() == 1
    assert where_tool_used(df, ["how_paper", "how_phone"]).count() == 2
    assert where_matches(df, "with_whom", "Nurse|Doctor").count() == 2


def test_recode(spark):
    df = spark.createDataFrame([("Other Indiret Care",), ("x",), (None,)], "s string")
    got = [r[0] for r in recode(df, "s", STAFF_RECODES["subcategory"]).collect()]
    assert got == ["Other Indirect Care", "x", None]


def test_attach_role_first_non_null_wins(spark):
    log = spark.createDataFrame([(1,), (2,), (3,)], "session_id long")
    a = spark.createDataFrame([(1, "Nurse"), (2, None)], "session_id long, role string")
    b = spark.createDataFrame([(2, "Clerk"), (1, "Other")], "session_id long, role string")
    got = sorted(map(tuple, attach_role(log, [a, b]).collect()))
    assert got == [(1, "Nurse"), (2, "Clerk"), (3, None)]


def test_prefer_lookup_and_complete_keys(spark):
    log = spark.createDataFrame([(1, "p1"), (2, "p2")], "session_id long, participant_id string")
    lk = spark.createDataFrame([(1, "L1"), (2, None)], "session_id long, participant_id_2 string")
    got = sorted(map(tuple, prefer_lookup(log, lk, "participant_id", "participant_id_2").collect()))
    assert got == [(1, "L1"), (2, "p2")]
    agg = spark.createDataFrame([(1, 5.0)], "session_id long, m double")
    full = sorted(map(tuple, complete_keys(agg, log).collect()))
    assert full == [(1, 5.0), (2, 0.0)]


def test_session_relative_time_keys(spark):
    df = spark.createDataFrame(
        [(1, 100, 200, 10, 20), (1, 100, 200, 15, 30), (2, 100, 200, 50, 60)],
        "session_id long, session_start_sec long, session_end_sec long, start_sec long, "
        "end_sec long")
    by_id = sorted((r.session_id, r.start_norm_sec, r.end_norm_sec)
                   for r in session_relative_time(df).collect())
    assert by_id == [(1, 0, 10), (1, 5, 20), (2, 0, 10)]
    by_clock = sorted((r.session_id, r.start_norm_sec) for r in session_relative_time(
        df, keys=("session_start_sec", "session_end_sec")).collect())
    assert by_clock == [(1, 0), (1, 5), (2, 40)]     # equal clock pair shares an origin


def test_renumber_tasks_one_session(spark):
    df = spark.createDataFrame([(5, 1, 9), (5, 2, 3), (6, 3, 4), (None, 4, 1)],
                               "session_id long, activity_id long, task_order long")
    got = sorted(map(tuple, renumber_tasks(df, [5]).select("session_id", "activity_id",
                                                            "task_order").collect()))
    assert got == [(5, 1, 1), (5, 2, 2), (6, 3, 4)]   # NULL session dropped, as filter(!x==v)


def test_clean_log_stages(spark, tmp_path):
    v1 = read_activity_log(spark, _write(tmp_path, "v1.csv", staff_csv()), "staff_v1")
    lk = read_lookup(spark, _write(tmp_path, "lk.csv", lookup_csv()))
    cfg = CleaningConfig(
        dataset="t", corrections=[
            Correction("t", "raw", "session_id", 504, "session_start_sec", 28800),
            Correction("t", "derived", "session_id", 501, "participant_id", "Z9"),
            Correction("t", "late", "session_id", 501, "session_end_sec", 3600)],
        recodes=STAFF_RECODES, exclude_sessions=[503])
    out = clean_log([Export(v1)], cfg, lk)
    rows = out.collect()
    assert {r.session_id for r in rows} == {501, 502, 504}
    s501 = [r for r in rows if r.session_id == 501]
    assert all(r.participant_id == "Z9" and r.session_end_sec == 3600 for r in s501)
    assert all(r.total_session_min == 60.0 for r in s501)      # late fix: not refreshed
    assert {r.what for r in s501} == {"Direct Care", "Professional Communication"}
    r502 = [r for r in rows if r.session_id == 502][0]
    assert r502.with_whom.count(", ") == 7 and r502.how.count(", ") == 3
    assert r502.role == "Physician" and r502.time_slot == "other"
    assert {r.role for r in rows if r.session_id == 504} == {None}
    assert "multi_with" not in out.columns and "elapsed_sec" not in out.columns
    # notebook labels: empty -> "No one"/"None"; v2 export requires a role
    nb = CleaningConfig(dataset="t", labels="notebook")
    out2 = clean_log([Export(v1, require_role=True)], nb, lk)
    assert {r.session_id for r in out2.collect()} == {501, 502}
    none_row = clean_log([Export(v1)], nb, lk).where(F.col("session_id") == 503).first()
    assert none_row.with_whom == "No one" and none_row.how == "None"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("2025-01-01", 1), ("2025-01-02", 2)], "session_date string, x long")
    p = write_processed(df, str(tmp_path / "proc"))
    back = spark.read.schema(df.schema).parquet(p)
    assert sorted(map(tuple, back.select("session_date", "x").collect())) == \
        sorted(map(tuple, df.collect()))
    assert back.where(F.col("session_date") == "2025-01-02").count() == 1
    cat = report_catalog(spark, [("a", "table a")])
    paths = write_report({"report_summary": cat, "a": df}, str(tmp_path / "rep"))
    got = read_report(spark, paths)
    assert got["report_summary"].first().description == "table a"
    assert got["a"].count() == 2


def test_streaming_ingest_matches_batch_chain(spark, tmp_path):
    from shiftlog.streaming.ingest import read_ingested, start_ingest
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text(staff_csv())
    lk = read_lookup(spark, _write(tmp_path, "lk.csv", lookup_csv()))
    cfg = CleaningConfig(dataset="t", recodes=STAFF_RECODES, exclude_sessions=[503])
    q = start_ingest(spark, str(inbox), cfg, str(tmp_path / "out"), str(tmp_path / "ck"),
                     lookups=lk)
    q.awaitTermination(120)
    got = read_ingested(spark, str(tmp_path / "out"))
    batch = clean_log([Export(read_activity_log(spark, str(inbox), "staff_v1"))], cfg, lk)
    cols = [c for c in batch.columns if c != "activity_id"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == \
        sorted(map(tuple, batch.select(*cols).collect()), key=str)


def test_renumber_tasks_keeps_every_row_and_column(spark):
    # a million rows in many splits, a session with 30 % of them, more columns
    from pyspark.sql import Window
    df = spark.range(0, 1_000_000, 1, 12).select(
        F.when(F.col("id") % 10 < 3, F.lit(1)).when(F.col("id") % 1000 == 5, F.lit(None))
         .otherwise(F.col("id") % 97 + 2).cast("long").alias("session_id"),
        F.col("id").alias("activity_id"), F.lit(0).cast("long").alias("task_order"),
        F.md5(F.col("id").cast("string")).alias("comment"))
    out = renumber_tasks(df)
    want = F.row_number().over(Window.partitionBy("session_id").orderBy("activity_id"))
    want = df.withColumn("task_order", want.cast("bigint"))
    total = [F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.hash(*df.columns))]
    assert out.columns == df.columns
    assert out.agg(*total).first() == want.agg(*total).first()


def test_renumber_tasks_hot_session_split_across_pieces(spark):
    # one session holds a third of all rows; numbering must stay exact
    from pyspark.sql import Window
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 97 + 2)
         .cast("long").alias("session_id"),
        (F.lit(10_000) - F.col("id")).alias("activity_id"),
        F.lit(0).cast("long").alias("task_order"))
    out = renumber_tasks(df, piece_rows=8)
    want = df.withColumn("task_order", F.row_number().over(
        Window.partitionBy("session_id").orderBy("activity_id")).cast("bigint"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_null_safe_role_join_and_union_helpers(spark):
    from shiftlog.operators.cleaning import select_renamed, union_all
    log = spark.createDataFrame([(1,), (None,)], "session_id long")
    lk = spark.createDataFrame([(1, "Nurse"), (None, "Other")], "session_id long, role string")
    plain = sorted(map(tuple, attach_role(log, lk).collect()), key=str)
    safe = sorted(map(tuple, attach_role(log, lk, null_safe=True).collect()), key=str)
    assert plain == sorted([(1, "Nurse"), (None, None)], key=str)
    assert safe == sorted([(1, "Nurse"), (None, "Other")], key=str)
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(2,)], "k long")
    assert union_all([a, b], fill_missing=True).count() == 2
    assert select_renamed(a, {"key": "k"}).columns == ["key"]


def test_observer_mean_per_session(spark):
    from shiftlog.operators.summaries import observer_summary
    df = spark.createDataFrame(
        [(1, 10, 60.0, 1.0, 60), (1, 10, 60.0, 1.0, 60), (1, 10, 60.0, 1.0, 60),
         (1, 11, 30.0, 1.0, 60)],
        "observer_id long, session_id long, total_session_min double, "
        "total_activity_min double, total_sec long")
    row = {r.observer_id: r for r in observer_summary(df).collect()}["1"]
    ses = {r.observer_id: r for r in observer_summary(df, per="session").collect()}["1"]
    assert row.avg_session_min == 52.5 and ses.avg_session_min == 45.0


def test_slice_and_fill(spark):
    from shiftlog.operators.cleaning import fill_null, keep_known, slice_by
    df = spark.createDataFrame([("Nurse", None), ("Physician", 2.0), (None, None)],
                               "role string, m double")
    assert slice_by(df, "role", "Nurse").count() == 1
    assert keep_known(df, "role").count() == 2
    assert sorted(r.m for r in fill_null(df, 0.0, ["m"]).collect()) == [0.0, 0.0, 2.0]


def test_patient_export_chain(spark, tmp_path):
    import csv
    import io
    from shiftlog.sources.forms import get_form
    f = get_form("patient")
    canon = [c for _, c, _ in f.columns]
    rows = [
        dict(observer_id=1, session_id=10300, task_id="1_10300_1", participant_id="x",
             session_date="d", session_start_sec="22:00:00", session_end_sec="23:00:00",
             start_sec="22:10:00", end_sec="22:40:00", total_sec="00:30:00",
             active_sec="00:30:00", what="Waiting Time", subcategory="0",
             with_doctor=0, with_nurse=0, with_no_one=1),
        dict(observer_id=1, session_id=10300, task_id="1_10300_2", participant_id="x",
             session_date="d", session_start_sec="22:00:00", session_end_sec="23:00:00",
             start_sec="22:40:00", end_sec="23:10:00", total_sec="00:30:00",
             active_sec="00:30:00", what="Consultation", subcategory="0",
             with_doctor=1, with_nurse=1, with_no_one=0),
        dict(observer_id=2, session_id=10301, task_id="2_10301_1", participant_id="y",
             session_date="d", session_start_sec="09:00:00", session_end_sec="10:00:00",
             start_sec="09:00:00", end_sec="09:30:00", total_sec="00:30:00",
             active_sec="00:30:00", what="Waiting Time", subcategory="0",
             with_doctor=0, with_nurse=0, with_no_one=0),
    ]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(f.raw_names)
    for r in rows:
        w.writerow([r.get(c, "") for c in canon])
    log = read_activity_log(spark, _write(tmp_path, "p.csv", out.getvalue()), "patient")
    from shiftlog.plans.sites import REFERENCE_PATIENT
    clean = clean_log([Export(log)], REFERENCE_PATIENT)
    assert "how" not in clean.columns and "role" not in clean.columns
    got = {r.task_id: r for r in clean.collect()}
    assert got["1_10300_1"].with_whom == "No one"
    assert got["1_10300_2"].with_whom == "Doctor, Nurse"
    assert got["2_10301_1"].with_whom == ""
    s = got["1_10300_1"]
    assert s.session_end_sec == 88580 and s.total_session_min == (88580 - 79200) / 60
    assert {r.end_norm_hms for r in got.values() if r.session_id == 10300} == {"03:50:28"}
    from shiftlog.operators.summaries import provider_contact_time, waiting_time
    pc = {r.session_id: r for r in provider_contact_time(clean).collect()}
    assert pc[10300].dr_nurse_min == 30.0 and pc[10300].dr_nurse_pct == 50.0
    assert pc[10301].dr_nurse_min == 0.0
    wt = {r.session_id: r.waiting_pct for r in waiting_time(clean).collect()}
    assert wt == {10300: 50.0, 10301: 100.0}


def test_clerk_export_two_lookups(spark, tmp_path):
    from shiftlog.sources.forms import get_form
    f = get_form("clerk")
    assert [c for c, _ in f.with_flags] == ["with_doctor", "with_nurse", "with_patient",
                                            "with_relative", "with_ahp", "with_other"]
    log = read_activity_log(spark, _write(tmp_path, "c.csv", staff_csv("clerk")), "clerk")
    a = spark.createDataFrame([(501, "Clerk")], "session_id long, role string")
    b = spark.createDataFrame([(501, "Other"), (502, "Nurse")], "session_id long, role string")
    clean = clean_log([Export(log)], CleaningConfig(dataset="c", form="clerk",
                                                    labels="notebook"), [a, b])
    roles = {r.session_id: r.role for r in clean.select("session_id", "role").collect()}
    assert roles == {501: "Clerk", 502: "Nurse", 503: None, 504: None}


def test_export_columns_matched_by_name(spark, tmp_path):
    import csv
    import io
    text = staff_csv()
    rows = list(csv.reader(io.StringIO(text)))
    # reorder columns and drop optional ones (comments, the multitask block)
    head = rows[0]
    keep = [i for i, h in enumerate(head) if h not in ("Comments", "multi with")]
    order = list(reversed(keep))
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for r in rows:
        w.writerow([r[i] for i in order])
    a = read_activity_log(spark, _write(tmp_path, "a.csv", text), "staff_v1", ordinal=False)
    b = read_activity_log(spark, _write(tmp_path, "b.csv", out.getvalue()), "staff_v1",
                          ordinal=False)
    cols = [c for c in a.columns if c not in ("comments", "multi_with")]
    assert sorted(map(tuple, a.select(*cols).collect())) == \
        sorted(map(tuple, b.select(*cols).collect()))
    assert b.where(F.col("comments").isNotNull()).count() == 0
    bad = "\n".join(",".join(r[1:]) for r in rows)      # no "observer id" column
    import pytest
    with pytest.raises(ValueError, match="observer_id"):
        read_activity_log(spark, _write(tmp_path, "c.csv", bad), "staff_v1")


def test_join_back_hot_key_is_salted_and_exact(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500 + 2)
         .cast("long").alias("session_id"),
        F.col("id").alias("activity_id"), (F.col("id") % 1000).alias("start_sec"),
        (F.col("id") % 1000 + 5).alias("end_sec"))
    hot = session_relative_time(df, hms=False, hot_rows=1000)
    plain = session_relative_time(df, hms=False)           # no key over the default bound
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, plain.collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = session_relative_time(df, hms=False, hot_rows=1000) \
            ._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the shuffle join is keyed on (session, salt): a hot session spreads out
    import re
    assert re.search(r"SortMergeJoin \[[^\]]*session_id[^\]]*__salt", plan), plan
    assert re.search(r"hashpartitioning\([^)]*session_id[^)]*\)[^)]*__salt", plan) or \
        re.search(r"hashpartitioning\([^\n]*__salt", plan)


def test_lookup_join_hot_session_split_by_aqe(spark):
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(30000).select(
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 500 + 2)
             .cast("long").alias("session_id"), F.col("id").alias("activity_id"))
        lk = spark.range(600).select(F.col("id").alias("session_id"),
                                     F.concat(F.lit("r"), F.col("id").cast("string")).alias("role"))
        out = attach_role(df, lk)
        assert out.where(F.col("role") == "r1").count() == 10000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_command_line_site_run(spark, tmp_path):
    from shiftlog.__main__ import main
    from shiftlog.sources.sinks import read_report
    v1 = _write(tmp_path, "v1.csv", staff_csv("staff_v1"))
    v2 = _write(tmp_path, "v2.csv", staff_csv("staff_v2"))
    lk = _write(tmp_path, "lk.csv", lookup_csv())
    out = str(tmp_path / "reports")
    paths = main(["--site", "hospital_staff", "--export", f"staff_v1={v1}",
                  "--export", f"staff_v2={v2}", "--lookup", lk, "--out", out, "--overview"])
    assert {"processed", "report_summary", "observer_summary", "sessions_times",
            "activity_summary", "session_detail", "overview_location_matrix"} <= set(paths)
    got = read_report(spark, {k: paths[k] for k in ("observer_summary", "processed")})
    # v1 keeps all 6 rows; v2 keeps only rows whose session has a role (501, 502)
    assert got["processed"].count() == 6 + 4
    assert got["observer_summary"].where(F.col("observer_id") == "Total").count() == 1


def test_salting_spreads_null_keys_and_keeps_null_safe_matches(spark):
    from shiftlog.operators.joins import SALT, add_salt, hot_keys
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7)
         .cast("long").alias("session_id"), F.col("id").alias("activity_id"))
    hot = hot_keys(log, ["session_id"], hot_rows=10_000)          # nothing is hot
    salted = add_salt(log, hot, ["session_id"])
    null_salts = {r[0] for r in salted.where(F.col("session_id").isNull())
                  .select(SALT).distinct().collect()}
    assert len(null_salts) > 10                                 # NULL keys spread out
    lk = spark.createDataFrame([(None, "x"), (1, "Nurse")], "session_id long, role string")
    plain = attach_role(salted, lk, hot=hot)
    safe = attach_role(salted, lk, hot=hot, null_safe=True)
    assert plain.where(F.col("role") == "x").count() == 0
    assert safe.where(F.col("role") == "x").count() == 1000
    assert safe.count() == plain.count() == 3000


def _site(spark, tmp_path, site, exports, lookups=(), overview=True):
    from shiftlog.__main__ import main
    from shiftlog.sources.sinks import read_report
    args = ["--site", site, "--out", str(tmp_path / "out")]
    for form, text in exports:
        args += ["--export", f"{form}={_write(tmp_path, f'{form}-{len(args)}.csv', text)}"]
    for i, text in enumerate(lookups):
        args += ["--lookup", _write(tmp_path, f"lk{i}.csv", text)]
    paths = main([*args, *(["--overview"] if overview else [])])
    return {k: df.collect() for k, df in read_report(spark, paths).items()}


def test_command_line_polyclinic(spark, tmp_path):
    lookup = ("participant id;participant_id_2;session id;health_professional_desc\n"
              "A1;Z9;501;Nurse\nC3;;504;Physician\n")
    got = _site(spark, tmp_path, "polyclinic_staff",
                [("staff_v1", staff_csv()), ("staff_v2", staff_csv("staff_v2"))], [lookup])
    # the script keeps the log's participant and rows without a role
    assert len(got["processed"]) == 12
    assert {r["participant_id"] for r in got["processed"] if r["session_id"] == 501} == {"A1"}
    assert {r["participant_id"] for r in got["overview_processed"] if r["session_id"] == 501} == {"Z9"}
    assert {r["participant_id"] for r in got["overview_processed"] if r["session_id"] == 504} == {"C3"}
    assert {r["how"] for r in got["overview_processed"] if r["session_id"] == 503} == {"None"}
    metrics = {r["metric"]: r["count"] for r in got["overview_dataset_overview"]}
    assert metrics["Unique sessions"] == 4 and metrics["- Nurses"] == 1 and "- NA" in metrics
    columns = got["overview_location_matrix"][0].asDict()
    assert {"corridors", "consultation_room"} <= set(columns)
    assert not {"xray_ct", "plaster_room", "medication_room"} & set(columns)
    cells = [(r["role_slice"], r["location"]) for r in got["overview_location_long"]]
    assert ("All", "ambulance_bay") in cells and ("Physician", "ambulance_bay") not in cells


def test_command_line_clerk(spark, tmp_path):
    second = "participant id;participant_id_2;session id;health_professional_desc\nC3;;504;Clerk\n"
    got = _site(spark, tmp_path, "clerk", [("clerk", staff_csv("clerk"))], [lookup_csv(), second])
    assert {(r["session_id"], r["role"]) for r in got["processed"]} == {
        (501, "Nurse"), (502, "Physician"), (503, None), (504, "Clerk")}
    assert "total_session_min" in got["sessions_times"][0].asDict()
    assert "role_slice" not in got["overview_activity_share"][0].asDict()
    assert "reception_desk" in got["overview_location_matrix"][0].asDict()
    assert "reception_desk" not in {r["location"] for r in got["overview_location_long"]}
    assert [r["metric"] for r in got["overview_dataset_overview"]] == [
        "Unique sessions", "Unique observers", "Unique HCWs"]


def test_command_line_patient(spark, tmp_path):
    got = _site(spark, tmp_path, "patient", [("patient", staff_csv("patient"))], overview=False)
    assert {"waiting_time_session", "with_dr_nurse_time"} <= set(got)
    assert "how" not in got["session_detail"][0].asDict()
    assert [r["session_id"] for r in got["waiting_time_session"]] == [502]
    with pytest.raises(SystemExit):
        _site(spark, tmp_path, "patient", [("patient", staff_csv("patient"))])


def test_hospital_notebook_renumbers_and_keeps_its_late_session(spark, tmp_path):
    """The notebook renumbers session 10203 and has no fix of 10260; the script
    the other way round."""
    rows = [(1, s, f"1_{s}_{i + 5}", "A", "2025-03-23", "08:00:00", "13:00:00", f"08:0{i}:00",
             f"08:1{i}:00", "00:05:00", "00:05:00", "Care", "0", "Corridors", "", *[0] * 12)
            for s in (10202, 10203, 10260) for i in range(2)]
    got = _site(spark, tmp_path, "hospital_staff", [("staff_v1", staff_csv(rows=rows))], [lookup_csv()])
    script = sorted((r["session_id"], r["task_order"]) for r in got["processed"])
    assert script == [(10203, 5), (10203, 5), (10203, 6), (10203, 6), (10260, 5), (10260, 6)]
    notebook = sorted((r["session_id"], r["task_order"]) for r in got["overview_processed"])
    assert notebook == [(10203, 1), (10203, 2), (10203, 3), (10203, 4), (10260, 5), (10260, 6)]
    assert {r["session_end_sec"] for r in got["processed"] if r["session_id"] == 10260} == {43276}
    assert {r["session_end_sec"] for r in got["overview_processed"]
            if r["session_id"] == 10260} == {46800}


def test_corrections_from_a_table(spark):
    from shiftlog.operators.cleaning import CORRECTION_SCHEMA, CorrectionTable
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "c", 30)],
                               "session_id long, participant_id string, session_end_sec long")
    rows = [("t", "raw", 1, "session_id", "1", "session_id", "2"),
            ("t", "raw", 2, "session_id", "2", "session_end_sec", "77"),
            ("t", "raw", 3, "session_id", "2", "session_end_sec", "78"),
            ("t", "late", 4, "participant_id", "b", "session_end_sec", "oops"),
            ("other", "raw", 5, "session_id", "2", "participant_id", "x")]
    table = spark.createDataFrame(rows, CORRECTION_SCHEMA)
    fixes = CorrectionTable(table, [("raw", "session_id", "session_id"),
                                    ("raw", "session_id", "session_end_sec"),
                                    ("late", "participant_id", "session_end_sec")], "t")
    fixes.check()
    got = fixes.apply(df, "raw")
    assert sorted(map(tuple, got.collect()), key=str) == [
        (2, "a", 78), (2, "b", 78), (None, "c", 30)]
    assert fixes.apply(df, "late").where("participant_id = 'b'").first()["session_end_sec"] is None
    with pytest.raises(ValueError, match="no step"):
        CorrectionTable(table, fixes.steps[:1], "t").check()


def test_union_ids_are_unique_over_exports(spark, tmp_path):
    paths = [_write(tmp_path, f"{i}.csv", staff_csv()) for i in range(3)]
    exports = [Export(read_activity_log(spark, p, "staff_v1")) for p in paths]
    log = clean_log(exports, CleaningConfig(dataset="t"))
    ids = [r["activity_id"] for r in log.select("activity_id").collect()]
    assert len(ids) == len(set(ids)) == 18


def test_require_role_keeps_the_origin_of_other_rows(spark):
    """A session without a role: rows of an export that requires one go, and
    do not set the origin of the others."""
    from tests.fixtures import ROW_KEYS
    base = dict.fromkeys(ROW_KEYS, 0) | {"session_id": 1, "task_id": "1_1_1", "what": "x",
                                         "subcategory": "0", "end_sec": 500, "elapsed_sec": 0}
    cols = ["activity_id", *base]
    kinds = ", ".join(f"{c} " + ("string" if c in ("task_id", "participant_id", "session_date", "what",
                                                   "subcategory", "location", "comments") else "bigint")
                      for c in cols)

    def rows(start):
        values = base | {"start_sec": start, "participant_id": "p", "session_date": "d",
                         "location": "l", "comments": "c"}
        return spark.createDataFrame([(1, *values.values())], kinds)

    lk = spark.createDataFrame([(2, "Nurse")], "session_id long, role string")
    for salted in (False, True):
        log = clean_log([Export(rows(300)), Export(rows(100), require_role=True)],
                        CleaningConfig(dataset="t", salted=salted, hot_rows=0), lk)
        assert [(r["start_sec"], r["start_norm_sec"]) for r in log.collect()] == [(300, 0)]
