import pytest
from pyspark.sql import functions as F

from shiftlog.operators import breakdowns as B
from shiftlog.operators import summaries as S

LOG = ("observer_id long, session_id long, participant_id string, session_date string, "
       "time_slot string, session_start_sec long, session_end_sec long, task_order long, "
       "what string, subcategory string, location string, with_whom string, how string, "
       "comments string, total_session_min double, total_activity_min double, total_sec long, "
       "role string, activity_id long, how_paper int, how_desktop int, how_mobile int, "
       "how_phone int")


def row(obs, sess, what, minutes, total_sec=60, who=None, loc="A", sub="0", role="Nurse",
        part="p", date="d1", aid=0, paper=0, desk=0):
    return (obs, sess, part, date, "morning", 0, 3600, 1, what, sub, loc, who, None, None,
            60.0, minutes, total_sec, role, aid, paper, desk, 0, 0)


@pytest.fixture
def log(spark):
    data = [
        row(1, 10, "Direct Care", 10.0, aid=1, who="Doctor", paper=1),
        row(1, 10, "Waiting Time", 5.0, aid=2, who="Relative"),
        row(1, 11, "Direct Care", 20.0, aid=3, who="Nurse, Other", desk=1, sub="Exam"),
        row(2, 12, "Waiting Time", 3.0, total_sec=None, aid=4, role="Physician"),
        row(2, 12, None, 1.0, aid=5, role=None, loc=None),
        row(2, 13, "Direct Care", 7.0, aid=6, who="doctor", role="Physician", date="d2",
            paper=1, desk=1, sub="Exam"),
        row(2, 13, "Direct Care", 3.0, aid=7, role="Physician", date="d3", sub="Tests"),
    ]
    return spark.createDataFrame(data, LOG)


def test_observer_summary_na_asymmetry(log):
    got = {r.observer_id: r for r in S.observer_summary(log).collect()}
    assert got["1"].sessions == 2 and got["1"].total_time_min == 35.0
    assert got["1"].total_time_sec == 180 and got["1"].total_time_hms == "00:03:00"
    assert got["2"].total_time_sec is None                     # NA propagates per observer
    assert got["Total"].total_time_sec == 360                  # Total skips NA
    assert got["Total"].sessions == 4
    assert got["1"].n_activities_avg == 2.0 and got["Total"].n_activities_avg == 2.0
    assert got["1"].avg_session_min == 60.0
    brief = S.observer_summary(log, brief=True).columns
    assert brief == ["observer_id", "sessions", "n_activities_avg", "avg_time_min"]


def test_activity_summary_pct_from_rounded(log):
    got = {r.what: r for r in S.activity_summary(log).collect()}
    assert got["Direct Care"].total_time_min == 40.0
    assert got["Direct Care"].total_sessions == 3
    assert got[None].total_time_min == 1.0
    assert abs(sum(r.pct_time for r in got.values()) - 100.0) < 0.2
    assert got["Direct Care"].pct_time == 81.6      # 40 / 49


def test_activity_summary_role_slices(log):
    rows = S.activity_summary(log, per_session=True, role="role").collect()
    slices = {(r.role_slice, r.what): r for r in rows}
    assert slices[("All", "Direct Care")].total_time_min == 40.0
    assert slices[("Physician", "Direct Care")].total_time_min == 10.0
    assert slices[(None, None)].total_time_min == 1.0          # true NULL role is not "All"
    assert slices[("All", "Direct Care")].avg_act_session == 1.0      # 4 rows / 3 sessions


def test_waiting_time_only_sessions_that_waited(log):
    got = {r.session_id: r for r in S.waiting_time(log).collect()}
    assert set(got) == {10, 12}
    assert got[10].waiting_time_min == 5.0 and got[10].total_session_min == 15.0
    assert got[10].waiting_pct == 33.33


def test_provider_contact_every_session(log):
    got = {r.session_id: r for r in S.provider_contact_time(log).collect()}
    assert set(got) == {10, 11, 12, 13}
    assert got[10].dr_nurse_min == 10.0 and got[10].dr_nurse_pct == 66.67
    assert got[12].dr_nurse_min == 0.0 and got[12].total_session_min == 0.0  # no contact
    assert got[13].dr_nurse_min == 7.0 and got[13].total_session_min == 10.0


def test_session_times_sum_per_session(log):
    rows = S.session_times(log).collect()
    s13 = [r for r in rows if r.session_id == 13]
    assert len(s13) == 2                                        # two dates in one session
    assert {r.total_session_sec for r in s13} == {120}
    assert [r.total_session_sec for r in rows if r.session_id == 12] == [None]


def test_session_detail_dedupes(spark, log):
    dup = log.unionByName(log)
    assert S.session_detail(dup).count() == S.session_detail(log).count()


def test_shares_and_rank(log):
    share = {r.what: r for r in B.activity_share(log).collect()}
    assert share["Direct Care"].display_rank == 1
    assert share["Direct Care"].activity_total_min == 49.0
    assert share["Direct Care"].pct_label == "81.6%"
    sub = {(r.what, r.subcategory): r.pct_time for r in B.subcategory_share(log).collect()}
    assert sub == {("Direct Care", "Exam"): 90.0, ("Direct Care", "Tests"): 10.0}


def test_tool_time_counts_each_tool(log):
    got = {r.what: r for r in B.tool_time(log).collect()}
    dc = got["Direct Care"]
    assert dc.paper_time == 17.0 and dc.computer_time == 27.0 and dc.total_time == 37.0
    long = B.tool_long(B.tool_time(log))
    assert long.count() == 4 * len(got)                         # keys x tool columns


def test_location_outputs(log):
    summ = {r.location: r for r in B.location_summary(log).collect()}
    assert summ["A"].activities_list == "Direct Care, Waiting Time"
    assert summ[None].activities_list == "NA"
    first = {r.location: r for r in B.location_summary(log, order="first").collect()}
    assert first["A"].activities_list == "Direct Care, Waiting Time"
    m = {r.what: r for r in B.location_matrix(log, [("a", "A"), ("b", "B")]).collect()}
    assert m["Direct Care"].a == 40.0 and m["Direct Care"].b == 0.0
    assert m[None].a == 0.0 and m[None].n_act == 1
    shown = B.location_matrix(log, [("a", "A"), ("b", "B")], show=["b"])
    assert shown.columns == ["what", "total_time", "n_act", "b"]      # A16 subset
    assert B.location_long(B.location_matrix(log, [("a", "A"), ("b", "B")]),
                           [("a", "A"), ("b", "B")]).count() == 2 * 3


def test_headcount_and_overview(log):
    hc = {r.metric: r["count"] for r in B.headcount_by_role(
        log, labels={"Nurse": "- Nurses"}).collect()}
    assert hc == {"- Nurses": 1, "Physician": 1, None: 1}
    ov = {r.metric: r["count"] for r in B.dataset_overview(log).collect()}
    assert ov == {"Unique sessions": 4, "Unique observers": 2, "Unique HCWs": 1}


def test_approx_distinct_option(log):
    exact = {r.what: r.total_sessions for r in S.activity_summary(log).collect()}
    approx = {r.what: r.total_sessions for r in
              S.activity_summary(log, approx_distinct=True).collect()}
    assert approx == exact                       # tiny sets are exact in HLL++
    ov = {r.metric: r["count"] for r in B.dataset_overview(log, approx_distinct=True).collect()}
    assert ov["Unique sessions"] == 4


def test_sorted_session_reports(log):
    ids = [r.session_id for r in S.waiting_time(log, sort=True).collect()]
    assert ids == sorted(ids)
    ids = [r.session_id for r in S.provider_contact_time(log, sort=True).collect()]
    assert ids == sorted(ids)


def test_na_total_sorts_last_and_negative_session_kept(spark, log):
    with_na = log.unionByName(log.limit(1).selectExpr(
        *[c if c != "what" else "'Broken' AS what" for c in log.columns])
        .withColumn("total_activity_min", F.lit(None).cast("double")))
    rows = S.activity_summary(with_na).collect()
    assert rows[-1].what == "Broken" and rows[-1].total_time_min is None    # N9
    assert [r.total_time_min for r in rows[:-1]] == sorted(
        [r.total_time_min for r in rows[:-1]], reverse=True)
    # a session that crosses midnight uncorrected keeps its negative length
    from shiftlog.operators.enrich import derive_times
    df = spark.createDataFrame([(1, 23 * 3600, 3600, "1_1_1", 60)],
                               "session_id long, session_start_sec long, session_end_sec long, "
                               "task_id string, active_sec long")
    assert derive_times(df).first().total_session_min == -1320.0
