"""Property checks: each generates a batch of cases and runs one Spark job."""

import os

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from oracle_queries import r as sql_round
from shiftlog.functions.labels import fold_flags
from shiftlog.functions.rounding import round_to
from shiftlog.functions.timefmt import hms_to_seconds, seconds_to_hms

SETTINGS = settings(max_examples=int(os.environ.get("PROPERTY_EXAMPLES", "5")), deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=400_000), min_size=1, max_size=200))
def test_hms_round_trip(spark, secs):
    df = spark.createDataFrame([(s,) for s in secs], "s long")
    back = [r[0] for r in df.select(hms_to_seconds(seconds_to_hms("s"))).collect()]
    assert back == secs


@SETTINGS
@given(st.lists(st.one_of(st.integers(-100_000, 100_000).map(lambda k: k / 40),
                          st.integers(-100_000, 100_000).map(lambda k: k / 200),
                          st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=200))
def test_rounding_matches_sql_rule(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = df.select("i", round_to("x", 0).alias("r0"), round_to("x", 1).alias("r1"),
                    round_to("x", 2).alias("r2")).orderBy("i").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(xs)))
    want = con.execute(f"SELECT i, {sql_round('x', 0)}, {sql_round('x', 1)}, "
                       f"{sql_round('x', 2)} FROM t ORDER BY i").fetchall()
    assert [tuple(r) for r in got] == [tuple(w) for w in want]


LABELS = ["Doctor", "Nurse", "Clerks", "Other"]


def r_paste_label(flags, empty):
    """The reference's label: paste0(ifelse(f == 1, "X, ", "")...) then drop the
    trailing ", "; a NULL flag is taken as not ticked."""
    text = "".join(f"{lab}, " for f, lab in zip(flags, LABELS) if f == 1)
    if text.endswith(", "):
        text = text[:-2]
    return empty if text == "" else text


@SETTINGS
@given(st.lists(st.tuples(*[st.sampled_from([0, 1, None])] * 4), min_size=1, max_size=200))
def test_fold_flags_matches_paste_model(spark, rows):
    cols = [f"f{i}" for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    spec = list(zip(cols, LABELS))
    got = df.select(fold_flags(spec).alias("a"), fold_flags(spec, empty="No one").alias("b")) \
            .collect()
    assert [g.a for g in got] == [r_paste_label(r, None) for r in rows]
    assert [g.b for g in got] == [r_paste_label(r, "No one") for r in rows]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([1, 1, 1, 2, 3, 4, 5, None]),
                          st.integers(0, 10_000)), min_size=1, max_size=300, unique_by=lambda t: t[1]),
       st.integers(1, 9))
def test_renumber_matches_window(spark, rows, pieces):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from shiftlog.operators.enrich import renumber_tasks
    df = spark.createDataFrame([(s, a, 0) for s, a in rows],
                               "session_id long, activity_id long, task_order long")
    got = renumber_tasks(df, piece_rows=pieces)
    want = df.withColumn("task_order", F.row_number().over(
        Window.partitionBy("session_id").orderBy("activity_id")).cast("bigint"))
    assert sorted(map(tuple, got.collect()), key=str) == \
        sorted(map(tuple, want.collect()), key=str)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([1, 1, 1, 1, 2, 3, None, None]),
                          st.integers(0, 86_400)), min_size=1, max_size=300),
       st.sampled_from([0, 3, 1_000_000]))
def test_relative_time_matches_window(spark, rows, hot_rows):
    """Aggregate + skew-safe join back == the window form, NULL sessions
    included, with and without hot keys."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from shiftlog.operators.enrich import session_relative_time
    from shiftlog.operators.joins import SALT
    df = spark.createDataFrame([(s, i, t, t + 60) for i, (s, t) in enumerate(rows)],
                               "session_id long, activity_id long, start_sec long, end_sec long")
    w = Window.partitionBy("session_id")
    want = df.select("activity_id", (F.col("start_sec") - F.min("start_sec").over(w))
                     .alias("start_norm_sec"))
    plain = session_relative_time(df, hms=False, hot_rows=hot_rows) \
        .select("activity_id", "start_norm_sec")
    w_rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, plain.collect())) == w_rows
    assert SALT not in plain.columns


def _model_observer_summary(rows):
    """R semantics: per observer (NA a group) and a Total row."""
    from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

    def rnd(x, d):
        if x is None:
            return None
        q = Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        mode = ROUND_HALF_EVEN if d == 0 else ROUND_HALF_UP
        return float(q.quantize(Decimal(1).scaleb(-d), mode))

    def summarise(rs, total):
        sess = {r[1] for r in rs}
        keyed = [r for r in rs if r[1] is not None]
        kdist = {r[1] for r in keyed}
        tsm = [r[2] for r in rs if r[2] is not None]
        act = [r[3] for r in rs]
        sec = [r[4] for r in rs]
        return (len(sess),
                rnd(len(keyed) / len(kdist), 0) if kdist else None,
                rnd(sum(tsm) / len(tsm), 2) if tsm else None,
                rnd(sum(act), 2) if None not in act else None,
                sum(s for s in sec if s is not None) if total
                else (sum(sec) if None not in sec else None))

    out = {}
    for obs in {r[0] for r in rows}:
        out[None if obs is None else str(obs)] = summarise([r for r in rows if r[0] == obs],
                                                           False)
    out["Total"] = summarise(rows, True)
    return out


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([10, 11, 12, None]),
                          st.one_of(st.none(), st.integers(0, 600).map(lambda s: s / 60)),
                          st.one_of(st.integers(0, 600).map(lambda s: s / 60), st.none()),
                          st.one_of(st.integers(0, 600), st.none())),
                min_size=1, max_size=60))
def test_observer_summary_matches_r_model(spark, rows):
    from shiftlog.operators.summaries import observer_summary
    df = spark.createDataFrame(rows, "observer_id long, session_id long, "
                                     "total_session_min double, total_activity_min double, "
                                     "total_sec long")
    got = {r.observer_id: (r.sessions, r.n_activities_avg, r.avg_session_min,
                           r.total_time_min, r.total_time_sec)
           for r in observer_summary(df).collect()}
    want = _model_observer_summary(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert g[0] == w[0] and g[4] == w[4], (k, g, w)
        for a, b in zip(g[1:4], w[1:4]):
            assert (a is None and b is None) or (a is not None and b is not None
                                                 and abs(a - b) < 1e-9), (k, g, w)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([10, 11, None]), st.sampled_from(["d1", None]),
                          st.sampled_from(["p1", "p2", None]),
                          st.one_of(st.integers(0, 600), st.none()),
                          st.sampled_from(["Waiting Time", "Care", None]),
                          st.one_of(st.integers(0, 600).map(lambda s: s / 60), st.none())),
                min_size=1, max_size=60))
def test_session_tables_match_models(spark, rows):
    from shiftlog.operators.summaries import session_times, waiting_time
    df = spark.createDataFrame(
        [(s, d, p, 1, "morning", 0, 100, sec, w, m) for s, d, p, sec, w, m in rows],
        "session_id long, session_date string, participant_id string, observer_id long, "
        "time_slot string, session_start_sec long, session_end_sec long, total_sec long, "
        "what string, total_activity_min double")
    # session times: distinct descriptions (NULL fields included), NA-propagating sum
    want = set()
    for s in {r[0] for r in rows}:
        secs = [r[3] for r in rows if r[0] == s]
        tot = None if None in secs else sum(secs)
        for r in rows:
            if r[0] == s:
                want.add((r[1], 1, "morning", s, r[2], 0, 100, tot))
    got = [tuple(r)[:8] for r in session_times(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # waiting time: sessions with a waiting row; NA-propagating sums, rounded
    wt = {r.session_id: r for r in waiting_time(df).collect()}
    waited = {r[0] for r in rows if r[4] == "Waiting Time"}
    assert set(wt) == waited
    for s in waited:
        mins = [r[5] for r in rows if r[0] == s and r[4] == "Waiting Time"]
        allm = [r[5] for r in rows if r[0] == s]
        w = None if None in mins else sum(mins)
        t = None if None in allm else sum(allm)
        assert (wt[s].waiting_time_min is None) == (w is None)
        assert (wt[s].total_session_min is None) == (t is None)
        if w is not None:
            assert abs(wt[s].waiting_time_min - w) < 0.006
        if t is not None:
            assert abs(wt[s].total_session_min - t) < 0.006


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from([10, 11, 12, None]),
                          st.sampled_from(["Doctor", "nurse, Other", "Relative", "", None]),
                          st.one_of(st.integers(1, 600).map(lambda s: s / 60), st.none())),
                min_size=1, max_size=60))
def test_provider_contact_matches_model(spark, rows):
    import re
    from shiftlog.operators.summaries import provider_contact_time

    def r2(x):
        return None if x is None else round(x + 0.0, 2)

    def psum(xs):
        return None if any(x is None for x in xs) else sum(xs)

    df = spark.createDataFrame(rows, "session_id long, with_whom string, "
                                     "total_activity_min double")
    got = {r.session_id: r for r in provider_contact_time(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for s in {r[0] for r in rows}:
        labels = {r[1] for r in rows if r[0] == s}
        t = {lab: psum([r[2] for r in rows if r[0] == s and r[1] == lab]) for lab in labels}
        tot = r2(psum(list(t.values())))
        hits = [lab for lab in labels
                if lab is not None and re.search("(?i)nurse|doctor", lab)]
        if not hits:
            want = (0.0, 0.0, 0.0)
        else:
            ts = [r2(t[lab]) for lab in hits]
            pcts = [None if (x is None or tot is None) else r2(x * 100 / tot) for x in ts]
            m, p = psum(ts), psum(pcts)
            want = (0.0 if m is None else m, 0.0 if tot is None else tot,
                    0.0 if p is None else p)
        g = (got[s].dr_nurse_min, got[s].total_session_min, got[s].dr_nurse_pct)
        assert all(abs(a - b) < 0.011 for a, b in zip(g, want)), (s, g, want)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["Care", "Wait", None]), st.sampled_from([1, 2, None]),
                          st.sampled_from(["A", "B", None]),
                          st.one_of(st.integers(1, 600).map(lambda s: s / 60), st.none())),
                min_size=1, max_size=60))
def test_activity_and_location_summaries_match_model(spark, rows):
    from shiftlog.operators.breakdowns import location_summary
    from shiftlog.operators.summaries import activity_summary

    def psum(xs):
        return None if any(x is None for x in xs) else sum(xs)

    df = spark.createDataFrame([(w, s, loc, m, i) for i, (w, s, loc, m) in enumerate(rows)],
                               "what string, session_id long, location string, "
                               "total_activity_min double, activity_id long")
    got = {r.what: r for r in activity_summary(df).collect()}
    whats = {r[0] for r in rows}
    assert set(got) == whats
    totals = {}
    for w in whats:
        rs = [r for r in rows if r[0] == w]
        assert got[w].total_sessions == len({r[1] for r in rs})        # NA counts once
        tot = psum([r[3] for r in rs])
        assert (got[w].total_time_min is None) == (tot is None)
        if tot is not None:
            assert abs(got[w].total_time_min - tot) < 0.006
            mins = [r[3] for r in rs]
            assert abs(got[w].max_time_min - max(mins)) < 0.006
        totals[w] = got[w].total_time_min
    grand = psum(list(totals.values()))
    for w in whats:
        if grand and totals[w] is not None:
            assert abs(got[w].pct_time - round(totals[w] / grand * 100, 1)) < 0.051
        else:
            assert got[w].pct_time is None
    for order in ("sorted", "first"):
        loc = {r.location: r for r in location_summary(df, order=order).collect()}
        assert set(loc) == {r[2] for r in rows}
        for place, r in loc.items():
            rs = [x for x in rows if x[2] == place]
            names = [("NA" if x[0] is None else x[0]) for x in rs]
            if order == "sorted":
                expect = ", ".join(sorted(set(names)))
            else:
                expect = ", ".join(dict.fromkeys(names))        # first-appearance order
            assert r.activities_list == expect
            assert r.n_sessions == len({x[1] for x in rs})


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["Care", None]), st.sampled_from([1, 2, None]),
                          st.sampled_from(["A", None]), st.sampled_from([0, 1, None]),
                          st.sampled_from([0, 1, None]), st.sampled_from(["Nurse", None]),
                          st.sampled_from(["p1", "p2", None]),
                          st.one_of(st.integers(1, 600).map(lambda s: s / 60), st.none())),
                min_size=1, max_size=60))
def test_tool_matrix_headcount_overview_match_models(spark, rows):
    from shiftlog.operators import breakdowns as B
    df = spark.createDataFrame(
        [(w, s, loc, p, d, 0, 0, role, part, 1, m) for w, s, loc, p, d, role, part, m in rows],
        "what string, session_id long, location string, how_paper int, how_desktop int, "
        "how_mobile int, how_phone int, role string, participant_id string, "
        "observer_id long, total_activity_min double")
    # tool time: rows with a tool flag set; NULL flags / minutes skipped
    tools = {r.what: r for r in B.tool_time(df).collect()}
    used = [r for r in rows if r[3] == 1 or r[4] == 1]
    assert set(tools) == {r[0] for r in used}
    for w, t in tools.items():
        rs = [r for r in used if r[0] == w]
        paper = sum(r[7] for r in rs if r[3] == 1 and r[7] is not None)
        total = sum(r[7] for r in rs if r[7] is not None)
        assert abs(t.paper_time - paper) < 0.051 and abs(t.total_time - total) < 0.051
    # location matrix: NULL location contributes to no location column
    m = {r.what: r for r in B.location_matrix(df, [("a", "A")]).collect()}
    for w, r in m.items():
        rs = [x for x in rows if x[0] == w]
        a = sum(x[7] for x in rs if x[2] == "A" and x[7] is not None)
        assert abs(r.a - a) < 0.051 and r.n_act == len(rs)
    # headcount and overview: NULL counted as a value / a group
    hc = {r.metric: r["count"] for r in B.headcount_by_role(df).collect()}
    pairs = {(r[6], r[5]) for r in rows}
    assert hc == {role: len({p for p, rr in pairs if rr == role}) for _, role in pairs}
    ov = {r.metric: r["count"] for r in B.dataset_overview(df).collect()}
    assert ov == {"Unique sessions": len({r[1] for r in rows}), "Unique observers": 1,
                  "Unique HCWs": len({r[6] for r in rows})}


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["Care", "Wait", None]),
                          st.sampled_from(["0", "S1", "S2", None]),
                          st.one_of(st.integers(1, 600).map(lambda s: s / 60), st.none())),
                min_size=1, max_size=60))
def test_shares_match_model(spark, rows):
    from shiftlog.operators.breakdowns import activity_share, subcategory_share
    df = spark.createDataFrame(rows, "what string, subcategory string, "
                                     "total_activity_min double")
    # activity share: NA minutes skipped, share of the grand total, rank by share
    got = {r.what: r for r in activity_share(df).collect()}
    t = {w: sum(r[2] for r in rows if r[0] == w and r[2] is not None) for w in {r[0] for r in rows}}
    grand = sum(t.values())
    assert set(got) == set(t)
    for w, r in got.items():
        assert abs(r.activity_time - t[w]) < 1e-6
        if grand:
            assert abs(r.pct_time - t[w] / grand * 100) < 0.051
        assert abs(r.activity_total_min - grand) < 0.051
    ranks = sorted(got.values(), key=lambda r: r.display_rank)
    assert [r.display_rank for r in ranks] == list(range(1, len(ranks) + 1))
    assert all(a.pct_time >= b.pct_time for a, b in zip(ranks, ranks[1:])
               if a.pct_time is not None and b.pct_time is not None)
    # subcategory share: rows with a subcategory other than "0", share within activity
    kept = [r for r in rows if r[1] is not None and r[1] != "0"]
    sub = {(r.what, r.subcategory): r for r in subcategory_share(df, digits=1).collect()}
    assert set(sub) == {(r[0], r[1]) for r in kept}
    for (w, s), r in sub.items():
        part = sum(x[2] for x in kept if x[0] == w and x[1] == s and x[2] is not None)
        whole = sum(x[2] for x in kept if x[0] == w and x[2] is not None)
        if whole:
            assert abs(r.pct_time - part / whole * 100) < 0.051
