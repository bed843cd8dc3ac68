"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark code, following the reference's
step-by-step forms (e.g. per (session, activity) sums then a per-session
window) where the Spark operators fuse steps.  Tables are the driver's
pre-registered views.
"""

from __future__ import annotations


def r(x: str, d: int) -> str:
    """The repo's rounding rule (fixed to 6 decimals first)."""
    dec = f"CAST(({x}) AS DECIMAL(38,6))"
    if d == 0:
        return f"round_even(CAST({dec} AS DOUBLE), 0)"
    return f"CAST(round({dec}, {d}) AS DOUBLE)"


def hms(s: str) -> str:
    return (f"CASE WHEN ({s}) IS NOT NULL THEN printf('%02d:%02d:%02d', "
            f"CAST(({s}) // 3600 AS BIGINT), CAST((({s}) % 3600) // 60 AS BIGINT), "
            f"CAST(({s}) % 60 AS BIGINT)) END")


def prop_sum(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


def ndist(x: str) -> str:
    return f"(count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END))"


def days(where: str = "TRUE") -> str:
    """Customer x day 1..31 lookup rows (session = custkey * 100 + day)."""
    return (f"FROM customer CROSS JOIN range(1, 32) AS d(day) "
            f"WHERE c_acctbal > 0 AND {where}")


SRC = r"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         TRY_CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k
  FROM events
),
base AS (
  SELECT event_id AS activity_id,
         user_id % 7 AS observer_id,
         CAST(user_id * 100 + day(ts) AS BIGINT) AS session_id,
         CASE WHEN user_id % 11 = 0 THEN NULL
              ELSE 'P' || CAST(user_id % 40 AS VARCHAR) END AS participant_id,
         strftime(ts, '%Y-%m-%d') AS session_date,
         CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS start_sec,
         CAST(round(value * 60) AS BIGINT) AS active_sec,
         k, user_id,
         event_type AS what,
         CASE WHEN k % 5 = 0 THEN '0' ELSE 'S' || CAST(k % 5 AS VARCHAR) END AS subcategory,
         CASE k % 6 WHEN 0 THEN 'Corridors' WHEN 1 THEN 'Workstation'
                    WHEN 2 THEN 'Treatment Room' WHEN 3 THEN 'Waiting Area'
                    WHEN 4 THEN 'Other' END AS location,
         CASE WHEN k % 9 = 0 THEN 'c' || CAST(k AS VARCHAR) END AS comments,
         CASE WHEN k = 97 THEN NULL WHEN k % 2 = 0 THEN 1 ELSE 0 END AS with_doctor,
         CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS with_nurse,
         CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS with_clerk,
         CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS with_prr,
         CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS with_patient,
         CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS with_relative,
         CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS with_ahp,
         CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS with_other,
         CASE WHEN k % 2 >= 1 THEN 1 ELSE 0 END AS how_paper,
         CASE WHEN k % 4 >= 2 THEN 1 ELSE 0 END AS how_desktop,
         CASE WHEN k % 8 >= 4 THEN 1 ELSE 0 END AS how_mobile,
         CASE WHEN k % 16 >= 8 THEN 1 ELSE 0 END AS how_phone
  FROM ev
),
base2 AS (
  SELECT *,
         start_sec + active_sec AS end_sec,
         CASE WHEN k = 98 AND user_id % 7 = 3 THEN NULL ELSE active_sec END AS total_sec,
         CASE WHEN k = 99 THEN 'x'
              ELSE CAST(observer_id AS VARCHAR) || '_' || CAST(session_id AS VARCHAR)
                   || '_' || CAST(activity_id AS VARCHAR) END AS task_id
  FROM base
),
src AS (
  SELECT activity_id, observer_id, session_id, task_id, participant_id, session_date,
         min(start_sec) OVER (PARTITION BY session_id) AS session_start_sec,
         max(end_sec) OVER (PARTITION BY session_id) AS session_end_sec,
         start_sec, end_sec, total_sec, active_sec, what, subcategory, location, comments,
         with_doctor, with_nurse, with_clerk, with_prr, with_patient, with_relative,
         with_ahp, with_other, how_paper, how_desktop, how_mobile, how_phone
  FROM base2
)"""

SRC_COLS = ("observer_id, session_id, task_id, participant_id, session_date, "
            "session_start_sec, session_end_sec, start_sec, end_sec, total_sec, active_sec, "
            "what, subcategory, location, comments, with_doctor, with_nurse, with_clerk, "
            "with_prr, with_patient, with_relative, with_ahp, with_other, how_paper, "
            "how_desktop, how_mobile, how_phone")

WITH_LABEL = ("concat_ws(', ', CASE WHEN with_doctor = 1 THEN 'Doctor' END, "
              "CASE WHEN with_nurse = 1 THEN 'Nurse' END, "
              "CASE WHEN with_clerk = 1 THEN 'Clerks' END, "
              "CASE WHEN with_prr = 1 THEN 'Patient Relation Reps' END, "
              "CASE WHEN with_patient = 1 THEN 'Patient' END, "
              "CASE WHEN with_relative = 1 THEN 'Relative' END, "
              "CASE WHEN with_ahp = 1 THEN 'Allied Health Professional' END, "
              "CASE WHEN with_other = 1 THEN 'Other' END)")
HOW_LABEL = ("concat_ws(', ', CASE WHEN how_paper = 1 THEN 'Paper' END, "
             "CASE WHEN how_desktop = 1 THEN 'Desktop Computer' END, "
             "CASE WHEN how_mobile = 1 THEN 'Mobile Computer' END, "
             "CASE WHEN how_phone = 1 THEN 'Phone' END)")

LOOKUP = f"lk AS (SELECT c_custkey * 100 + day AS session_id, c_mktsegment AS role {days()})"

CLEAN = SRC + ",\n" + LOOKUP + r""",
fix1 AS (
  SELECT * REPLACE (CASE WHEN session_id = 801 THEN 802 ELSE session_id END AS session_id)
  FROM src
),
fix2 AS (
  SELECT * REPLACE (
    CASE WHEN session_id = 802 THEN 32400 ELSE session_start_sec END AS session_start_sec,
    CASE WHEN session_id = 802 THEN 79200 ELSE session_end_sec END AS session_end_sec)
  FROM fix1
),
joined AS (SELECT fix2.*, lk.role FROM fix2 LEFT JOIN lk ON fix2.session_id = lk.session_id),
der AS (
  SELECT * REPLACE (
           CASE WHEN session_id = 1203 THEN 'GL 16' WHEN session_id = 1101 THEN 'GL14'
                ELSE participant_id END AS participant_id,
           CASE WHEN what = 'signup' THEN 'sign-up' ELSE what END AS what,
           CASE WHEN subcategory = 'S4' THEN 'S 4' ELSE subcategory END AS subcategory),
         CAST(session_end_sec - session_start_sec AS DOUBLE) / 60 AS total_session_min,
         CAST(active_sec AS DOUBLE) / 60 AS total_activity_min,
         CASE WHEN floor(session_start_sec / 3600) BETWEEN 7 AND 11 THEN 'morning'
              WHEN floor(session_start_sec / 3600) BETWEEN 12 AND 16 THEN 'afternoon'
              WHEN floor(session_start_sec / 3600) BETWEEN 17 AND 20 THEN 'evening'
              ELSE 'other' END AS time_slot,
         TRY_CAST(NULLIF(regexp_extract(task_id, '_(\d+)$', 1), '') AS BIGINT) AS task_order
  FROM joined
),
kept AS (
  SELECT * REPLACE (CASE WHEN session_id = 902 THEN 43276 ELSE session_end_sec END
                    AS session_end_sec)
  FROM der
  WHERE session_id NOT IN (1003, 1104) AND task_id <> '1_801_7'
),
lab AS (
  SELECT *, """ + f"NULLIF({WITH_LABEL}, '') AS with_whom, NULLIF({HOW_LABEL}, '') AS how" + r"""
  FROM kept
),
norm AS (
  SELECT *,
         start_sec - min(start_sec) OVER (PARTITION BY session_id) AS start_norm_sec,
         end_sec - min(start_sec) OVER (PARTITION BY session_id) AS end_norm_sec
  FROM lab
),
clean AS (
  SELECT *, """ + f"{hms('start_norm_sec')} AS start_norm_hms, {hms('end_norm_sec')} AS end_norm_hms" + """
  FROM norm
)"""


def with_src(body: str) -> str:
    return "WITH " + SRC + "\n" + body


def with_clean(body: str, extra: str = "") -> str:
    return "WITH " + CLEAN + (",\n" + extra if extra else "") + "\n" + body


X = "total_activity_min"

Q: dict[str, str] = {}

# --- sources and sinks ------------------------------------------------------
Q["log_csv_roundtrip"] = with_src(f"SELECT {SRC_COLS} FROM src")
Q["log_csv_quoted_roundtrip"] = with_src(f"""
SELECT {SRC_COLS.replace('comments', """CASE
         WHEN TRY_CAST(substr(comments, 2) AS INT) % 2 = 0
           THEN 'said "' || comments || '", then' || chr(10) || 'left'
         WHEN TRY_CAST(substr(comments, 2) AS INT) % 3 = 0 THEN substr(comments, 2) || chr(34)
         ELSE comments END AS comments""")}
FROM src""")
Q["lookup_csv_roundtrip"] = (
    f"SELECT CAST(c_custkey * 100 + day AS BIGINT) AS session_id, c_mktsegment AS role {days()}")

Q["lookup_two_layouts"] = Q["lookup_csv_roundtrip"]

ACTIVITY_SUMMARY = with_clean(f"""
SELECT what, total_sessions, total_time_min, avg_time_min, max_time_min, min_time_min,
       {r('(total_time_min / NULLIF((SELECT CASE WHEN count(total_time_min) = count(*) THEN sum(total_time_min) END FROM rr), 0)) * 100', 1)} AS pct_time
       __EXTRA__
FROM rr""", f"""
g AS (
  SELECT what, {ndist('session_id')} AS total_sessions,
         {prop_sum(X)} AS t,
         CASE WHEN count({X}) = count(*) THEN avg({X}) END AS a,
         CASE WHEN count({X}) = count(*) THEN max({X}) END AS mx,
         CASE WHEN count({X}) = count(*) THEN min({X}) END AS mn
  FROM clean GROUP BY what
),
rr AS (
  SELECT what, total_sessions, {r('t', 2)} AS total_time_min, {r('a', 2)} AS avg_time_min,
         {r('mx', 2)} AS max_time_min, {r('mn', 2)} AS min_time_min
  FROM g
)""")
Q["report_bundle_roundtrip"] = ACTIVITY_SUMMARY.replace(
    "__EXTRA__", ", 'Per activity: sessions, total, mean, max, min minutes and share' "
                 "AS sheet_description")
Q["activity_summary"] = ACTIVITY_SUMMARY.replace("__EXTRA__", "")

CLEAN_COLS = ("activity_id, " + SRC_COLS + ", role, total_session_min, total_activity_min, "
              "time_slot, task_order, with_whom, how, start_norm_sec, end_norm_sec, "
              "start_norm_hms, end_norm_hms")
Q["clean_log"] = with_clean(f"SELECT {CLEAN_COLS} FROM clean")
Q["processed_log_roundtrip"] = Q["clean_log"]
Q["streaming_clean_log"] = with_clean(
    f"SELECT {CLEAN_COLS.replace('activity_id, ', '', 1)} FROM clean")

# --- joins and derived columns ----------------------------------------------
Q["role_two_lookups"] = with_src(f""",
l1 AS (SELECT c_custkey * 100 + day AS session_id, c_mktsegment AS role
       {days('c_nationkey < 12')}),
l2 AS (SELECT c_custkey * 100 + day AS session_id, 'N' || CAST(c_nationkey AS VARCHAR) AS role
       {days()})
SELECT s.activity_id, s.session_id, coalesce(l1.role, l2.role) AS role
FROM src s LEFT JOIN l1 ON s.session_id = l1.session_id
           LEFT JOIN l2 ON s.session_id = l2.session_id""")

Q["prefer_lookup_participant"] = with_src(f""",
lp AS (SELECT c_custkey * 100 + day AS session_id,
              CASE WHEN c_acctbal > 5000 THEN c_name END AS participant_id_2 {days()})
SELECT s.activity_id, s.session_id, coalesce(lp.participant_id_2, s.participant_id) AS participant_id
FROM src s LEFT JOIN lp ON s.session_id = lp.session_id""")

Q["with_whom_label"] = with_src(
    f"SELECT activity_id, NULLIF({WITH_LABEL}, '') AS with_whom, "
    f"coalesce(NULLIF({WITH_LABEL}, ''), 'No one') AS with_whom_nb FROM src")
Q["how_label"] = with_src(
    f"SELECT activity_id, NULLIF({HOW_LABEL}, '') AS how, "
    f"coalesce(NULLIF({HOW_LABEL}, ''), 'None') AS how_nb FROM src")

Q["session_relative_time"] = with_clean(
    "SELECT activity_id, session_id, start_norm_sec, end_norm_sec, start_norm_hms, "
    "end_norm_hms FROM clean")

Q["session_relative_time_clock"] = with_src(f""",
n AS (
  SELECT activity_id, session_start_sec, session_end_sec,
         start_sec - min(start_sec) OVER (PARTITION BY session_start_sec, session_end_sec) AS s0,
         end_sec - min(start_sec) OVER (PARTITION BY session_start_sec, session_end_sec) AS e0
  FROM src
)
SELECT activity_id, session_start_sec, session_end_sec, s0 AS start_norm_sec, e0 AS end_norm_sec,
       {hms('s0')} AS start_norm_hms, {hms('e0')} AS end_norm_hms
FROM n""")

Q["time_slots"] = with_clean("SELECT DISTINCT session_id, session_start_sec, time_slot FROM clean")
Q["task_order"] = with_clean("SELECT activity_id, task_id, task_order FROM clean")
Q["renumber_tasks"] = with_clean(
    "SELECT activity_id, session_id, "
    "row_number() OVER (PARTITION BY session_id ORDER BY activity_id) AS task_order FROM clean")

# --- summaries ----------------------------------------------------------------
Q["observer_summary"] = with_clean(f"""
SELECT observer_id, sessions, n_activities_avg, avg_session_min, total_time_min,
       total_time_sec, {hms('total_time_sec')} AS total_time_hms
FROM (
  SELECT CASE WHEN grouping(observer_id) = 1 THEN 'Total'
              ELSE CAST(observer_id AS VARCHAR) END AS observer_id,
         {ndist('session_id')} AS sessions,
         {r('count(session_id) / count(DISTINCT session_id)', 0)} AS n_activities_avg,
         {r('avg(total_session_min)', 2)} AS avg_session_min,
         {r(prop_sum(X), 2)} AS total_time_min,
         CAST(CASE WHEN grouping(observer_id) = 1 THEN coalesce(sum(total_sec), 0)
                   ELSE {prop_sum('total_sec')} END AS BIGINT) AS total_time_sec
  FROM clean GROUP BY ROLLUP (observer_id)
) o""")

Q["observer_summary_brief"] = with_clean(f"""
SELECT observer_id, {ndist('session_id')} AS sessions,
       {r('count(session_id) / count(DISTINCT session_id)', 0)} AS n_activities_avg,
       {r('avg(total_session_min)', 2)} AS avg_time_min
FROM clean GROUP BY observer_id""")

Q["activity_summary_by_role"] = with_clean(f"""
SELECT role_slice, what, total_sessions, avg_act_session, total_time_min, avg_time_min,
       max_time_min, min_time_min,
       {r('(total_time_min / NULLIF(CASE WHEN count(total_time_min) OVER w = count(*) OVER w THEN sum(total_time_min) OVER w END, 0)) * 100', 1)} AS pct_time
FROM rr WINDOW w AS (PARTITION BY role_slice)""", f"""
g AS (
  SELECT CASE WHEN grouping(role) = 1 THEN 'All' ELSE role END AS role_slice, what,
         {ndist('session_id')} AS total_sessions,
         {r(f"count(*) / {ndist('session_id')}", 0)} AS avg_act_session,
         {prop_sum(X)} AS t,
         CASE WHEN count({X}) = count(*) THEN avg({X}) END AS a,
         CASE WHEN count({X}) = count(*) THEN max({X}) END AS mx,
         CASE WHEN count({X}) = count(*) THEN min({X}) END AS mn
  FROM clean GROUP BY GROUPING SETS ((role, what), (what))
),
rr AS (
  SELECT role_slice, what, total_sessions, avg_act_session, {r('t', 2)} AS total_time_min,
         {r('a', 2)} AS avg_time_min, {r('mx', 2)} AS max_time_min, {r('mn', 2)} AS min_time_min
  FROM g
)""")

Q["waiting_time"] = with_clean(f"""
SELECT session_id, what, {r('t', 2)} AS waiting_time_min, {r('tot', 2)} AS total_session_min,
       {r(f"({r('t', 2)} * 100) / NULLIF({r('tot', 2)}, 0)", 2)} AS waiting_pct
FROM s WHERE what = 'view'""", f"""
g AS (SELECT session_id, what, {prop_sum(X)} AS t FROM clean GROUP BY session_id, what),
s AS (
  SELECT session_id, what, t,
         CASE WHEN count(t) OVER w = count(*) OVER w THEN sum(t) OVER w END AS tot
  FROM g WINDOW w AS (PARTITION BY session_id)
)""")

Q["provider_contact_time"] = with_clean(f"""
SELECT sp.session_id,
       coalesce({r('a.m', 2)}, 0) AS dr_nurse_min,
       coalesce(a.total_session_min, 0) AS total_session_min,
       coalesce({r('a.p', 2)}, 0) AS dr_nurse_pct
FROM sp LEFT JOIN a ON sp.session_id = a.session_id""", f"""
g AS (SELECT session_id, with_whom, {prop_sum(X)} AS t FROM clean GROUP BY session_id, with_whom),
s AS (
  SELECT session_id, with_whom, {r('t', 2)} AS t,
         {r('CASE WHEN count(t) OVER w = count(*) OVER w THEN sum(t) OVER w END', 2)} AS tot
  FROM g WINDOW w AS (PARTITION BY session_id)
),
f AS (
  SELECT session_id, t, tot, {r('(t * 100) / NULLIF(tot, 0)', 2)} AS pct
  FROM s WHERE regexp_matches(with_whom, '(?i)Nurse|Doctor')
),
a AS (
  SELECT session_id, tot AS total_session_min, {prop_sum('t')} AS m, {prop_sum('pct')} AS p
  FROM f GROUP BY session_id, tot
),
sp AS (SELECT DISTINCT session_id FROM clean)""")

Q["session_times"] = with_clean(f"""
SELECT DISTINCT session_date, observer_id, time_slot, session_id, participant_id,
       session_start_sec, session_end_sec, tot AS total_session_sec,
       {hms('tot')} AS total_session_hms
FROM (
  SELECT *, CAST(CASE WHEN count(total_sec) OVER w = count(*) OVER w
                      THEN sum(total_sec) OVER w END AS BIGINT) AS tot
  FROM clean WINDOW w AS (PARTITION BY session_id)
) x""")

Q["session_minutes"] = with_clean(f"""
SELECT DISTINCT session_date, observer_id, time_slot, session_id, participant_id,
       session_start_sec, session_end_sec, {r('total_session_min', 2)} AS total_session_min
FROM clean""")

Q["session_detail"] = with_clean(f"""
SELECT DISTINCT session_id, observer_id, task_order, what, location, with_whom, how, comments,
       {r(X, 2)} AS total_activity_min, {r(X + ' * 60', 2)} AS total_time_sec
FROM clean""")

# --- breakdowns ---------------------------------------------------------------
Q["activity_share"] = with_clean(f"""
SELECT what, {r('t', 6)} AS activity_time,
       {r('(t / NULLIF((SELECT sum(t) FROM g), 0)) * 100', 1)} AS pct_time,
       CASE WHEN p > 2.7 THEN regexp_replace(CAST(p AS VARCHAR), '\\.0$', '') || '%' ELSE '' END
         AS pct_label,
       row_number() OVER (ORDER BY p DESC NULLS LAST, what ASC NULLS LAST) AS display_rank,
       {r('(SELECT sum(t) FROM g)', 1)} AS activity_total_min
FROM (SELECT *, {r('(t / NULLIF((SELECT sum(t) FROM g), 0)) * 100', 1)} AS p FROM g) x""",
    f"g AS (SELECT what, coalesce(sum({X}), 0) AS t FROM clean GROUP BY what)")

Q["activity_share_by_role"] = with_clean(f"""
SELECT role_slice, what, {r('t', 6)} AS activity_time, p AS pct_time,
       CASE WHEN p > 2.7 THEN regexp_replace(CAST(p AS VARCHAR), '\\.0$', '') || '%' ELSE '' END
         AS pct_label,
       row_number() OVER (PARTITION BY role_slice ORDER BY p DESC NULLS LAST, what ASC NULLS LAST)
         AS display_rank,
       {r('sum(t) OVER (PARTITION BY role_slice)', 1)} AS activity_total_min
FROM (SELECT *, {r('(t / NULLIF(sum(t) OVER (PARTITION BY role_slice), 0)) * 100', 1)} AS p
      FROM g) x""",
    f"""g AS (SELECT CASE WHEN grouping(role) = 1 THEN 'All' ELSE role END AS role_slice, what,
              coalesce(sum({X}), 0) AS t
       FROM clean GROUP BY GROUPING SETS ((role, what), (what)))""")

LABEL = "regexp_replace(CAST(pct_time AS VARCHAR), '\\.0$', '') || '%' AS pct_label"

Q["subcategory_share"] = with_clean(f"""
SELECT *, {LABEL} FROM (
SELECT what, subcategory, {r('t', 6)} AS activity_time,
       {r('(t / NULLIF(sum(t) OVER (PARTITION BY what), 0)) * 100', 0)} AS pct_time
FROM g) x""", f"""g AS (SELECT what, subcategory, coalesce(sum({X}), 0) AS t FROM clean
       WHERE subcategory <> '0' GROUP BY what, subcategory)""")

Q["subcategory_share_by_role"] = with_clean(f"""
SELECT *, {LABEL} FROM (
SELECT role_slice, what, subcategory, {r('t', 6)} AS activity_time,
       {r('(t / NULLIF(sum(t) OVER (PARTITION BY role_slice, what), 0)) * 100', 1)} AS pct_time
FROM g) x""", f"""g AS (SELECT CASE WHEN grouping(role) = 1 THEN 'All' ELSE role END AS role_slice,
              what, subcategory, coalesce(sum({X}), 0) AS t
       FROM clean WHERE subcategory <> '0'
       GROUP BY GROUPING SETS ((role, what, subcategory), (what, subcategory)))""")

TOOL_USED = "(how_paper = 1 OR how_desktop = 1 OR how_mobile = 1 OR how_phone = 1)"


def tool_cols() -> str:
    return ", ".join([
        f"{r(f'coalesce(sum({X}), 0)', 1)} AS total_time",
        f"{r(f'coalesce(sum({X} * how_paper), 0)', 1)} AS paper_time",
        f"{r(f'coalesce(sum({X} * how_desktop), 0)', 1)} AS computer_time",
        f"{r(f'coalesce(sum({X} * how_mobile), 0)', 1)} AS mobile_time",
        f"{r(f'coalesce(sum({X} * how_phone), 0)', 1)} AS phone_time"])


Q["tool_by_activity"] = with_clean(
    f"SELECT what, {tool_cols()} FROM clean WHERE {TOOL_USED} GROUP BY what")
Q["tool_by_location"] = with_clean(
    f"SELECT location, {tool_cols()} FROM clean WHERE {TOOL_USED} GROUP BY location")
Q["tool_by_activity_by_role"] = with_clean(
    f"SELECT CASE WHEN grouping(role) = 1 THEN 'All' ELSE role END AS role_slice, what, "
    f"{tool_cols()} FROM clean WHERE {TOOL_USED} GROUP BY GROUPING SETS ((role, what), (what))")


def long_form(src: str, key: str, cols: list[tuple[str, str]], name: str) -> str:
    parts = [f"SELECT {key}, '{label}' AS {name}, CAST({c} AS DOUBLE) AS minutes FROM {src}"
             for c, label in cols]
    u = "\nUNION ALL\n".join(parts)
    return (f"SELECT {key}, {name}, minutes, {r('log10(minutes + 1)', 6)} AS heat, "
            f"{r('minutes', 1)} AS label FROM ({u}) u")


Q["tool_long"] = with_clean(
    long_form("tt", "what", [("paper_time", "Paper Time"), ("computer_time", "Computer Time"),
                             ("mobile_time", "Mobile Time"), ("phone_time", "Phone Time")],
              "tool"),
    f"tt AS (SELECT what, {tool_cols()} FROM clean WHERE {TOOL_USED} GROUP BY what)")

Q["location_summary"] = with_clean(f"""
SELECT location, {ndist('session_id')} AS n_sessions, {r(prop_sum(X), 2)} AS total_time_min,
       string_agg(DISTINCT coalesce(what, 'NA'), ', ' ORDER BY coalesce(what, 'NA'))
         AS activities_list
FROM clean GROUP BY location""")

Q["location_summary_first"] = with_clean(f"""
SELECT a.location, a.n_sessions, a.total_time_min, l.activities_list
FROM a LEFT JOIN l ON a.location IS NOT DISTINCT FROM l.location""", f"""
a AS (SELECT location, {ndist('session_id')} AS n_sessions, {r(prop_sum(X), 2)} AS total_time_min
      FROM clean GROUP BY location),
f AS (SELECT location, coalesce(what, 'NA') AS item, min(activity_id) AS first_id
      FROM clean GROUP BY location, coalesce(what, 'NA')),
l AS (SELECT location, string_agg(item, ', ' ORDER BY first_id) AS activities_list
      FROM f GROUP BY location)""")

EVENT_LOCS = [("corridors", "Corridors"), ("workstation", "Workstation"),
              ("treatment_room", "Treatment Room"), ("waiting_area", "Waiting Area"),
              ("other", "Other")]


def matrix_cols() -> str:
    cols = [f"{r(f'coalesce(sum({X}), 0)', 1)} AS total_time", "count(*) AS n_act"]
    cols += [f"{r(f'coalesce(sum(CASE WHEN location = {chr(39)}{v}{chr(39)} THEN {X} END), 0)', 1)} AS {c}"
             for c, v in EVENT_LOCS]
    return ", ".join(cols)


Q["location_matrix"] = with_clean(f"SELECT what, {matrix_cols()} FROM clean GROUP BY what")
Q["location_matrix_by_role"] = with_clean(
    f"SELECT CASE WHEN grouping(role) = 1 THEN 'All' ELSE role END AS role_slice, what, "
    f"{matrix_cols()} FROM clean GROUP BY GROUPING SETS ((role, what), (what))")
Q["location_long"] = with_clean(
    long_form("m", "what", [(c, c) for c, _ in EVENT_LOCS], "location"),
    f"m AS (SELECT what, {matrix_cols()} FROM clean GROUP BY what)")

ROLE_LABEL = ("CASE role WHEN 'BUILDING' THEN '- Building' "
              "WHEN 'AUTOMOBILE' THEN '- Automobile' ELSE {default} END")

Q["headcount_by_role"] = with_clean(
    f"SELECT {ROLE_LABEL.format(default='role')} AS metric, count(*) AS count "
    f"FROM (SELECT DISTINCT participant_id, role FROM clean) d GROUP BY role")
Q["headcount_by_role_sessions"] = with_clean(
    f"SELECT {ROLE_LABEL.format(default=chr(39) + '- ' + chr(39) + ' || coalesce(role, ' + chr(39) + 'NA' + chr(39) + ')')} AS metric, "
    f"count(*) AS count "
    f"FROM (SELECT DISTINCT participant_id, session_id, role FROM clean) d GROUP BY role")
Q["dataset_overview"] = with_clean(f"""
SELECT 'Unique sessions' AS metric, {ndist('session_id')} AS count FROM clean
UNION ALL SELECT 'Unique observers', {ndist('observer_id')} FROM clean
UNION ALL SELECT 'Unique HCWs', {ndist('participant_id')} FROM clean
UNION ALL SELECT {ROLE_LABEL.format(default='role')}, count(*)
          FROM (SELECT DISTINCT participant_id, role FROM clean) d GROUP BY role""")


# --- the other cleaning chains ----------------------------------------------

DERIVED = r"""CAST(session_end_sec - session_start_sec AS DOUBLE) / 60 AS total_session_min,
         CAST(active_sec AS DOUBLE) / 60 AS total_activity_min,
         CASE WHEN floor(session_start_sec / 3600) BETWEEN 7 AND 11 THEN 'morning'
              WHEN floor(session_start_sec / 3600) BETWEEN 12 AND 16 THEN 'afternoon'
              WHEN floor(session_start_sec / 3600) BETWEEN 17 AND 20 THEN 'evening'
              ELSE 'other' END AS time_slot,
         TRY_CAST(NULLIF(regexp_extract(task_id, '_(\d+)$', 1), '') AS BIGINT) AS task_order"""


def norm_ctes(src: str, end_fix: str = "end_norm_sec") -> str:
    return f"""n0 AS (
  SELECT *,
         start_sec - min(start_sec) OVER (PARTITION BY session_id) AS start_norm_sec,
         end_sec - min(start_sec) OVER (PARTITION BY session_id) AS end_norm_sec
  FROM {src}
),
n1 AS (SELECT * REPLACE ({end_fix} AS end_norm_sec) FROM n0),
out AS (SELECT *, {hms('start_norm_sec')} AS start_norm_hms, {hms('end_norm_sec')} AS end_norm_hms
        FROM n1)"""


PATIENT_BODY = ("concat_ws(', ', CASE WHEN with_doctor = 1 THEN 'Doctor' END, "
                "CASE WHEN with_nurse = 1 THEN 'Nurse' END, "
                "CASE WHEN with_clerk = 1 THEN 'Clerk' END, "
                "CASE WHEN with_prr = 1 THEN 'Patient Relation Reps' END, "
                "CASE WHEN with_relative = 1 THEN 'Relative' END, "
                "CASE WHEN with_ahp = 1 THEN 'Allied Health Professional' END, "
                "CASE WHEN with_other = 1 THEN 'Other' END)")

PATIENT = SRC + f""",
psrc AS (
  SELECT * EXCLUDE (how_paper, how_desktop, how_mobile, how_phone, with_patient),
         with_patient AS with_no_one
  FROM src
),
p1 AS (
  SELECT * REPLACE (CASE WHEN session_id = 1203 THEN 'TL8' ELSE participant_id END
                      AS participant_id,
                    CASE WHEN session_id = 902 THEN 88580 ELSE session_end_sec END
                      AS session_end_sec)
  FROM psrc
),
p2 AS (SELECT *, {DERIVED}, {PATIENT_BODY} AS body FROM p1),
p3 AS (
  SELECT * EXCLUDE (body),
         CASE WHEN with_no_one = 1 THEN CASE WHEN body = '' THEN 'No one'
                                             ELSE body || ', No one' END
              ELSE body END AS with_whom
  FROM p2
),
{norm_ctes('p3', "CASE WHEN session_id = 902 THEN 13828 ELSE end_norm_sec END")},
clean AS (SELECT * FROM out)"""

Q["patient_clean_log"] = "WITH " + PATIENT + "\nSELECT * FROM clean"

PROVIDER_SELECT = Q["provider_contact_time"][Q["provider_contact_time"].index("\nSELECT sp.session_id"):]
PROVIDER_CTES = Q["provider_contact_time"][len("WITH " + CLEAN + ",\n"):
                                           Q["provider_contact_time"].index("\nSELECT sp.session_id")]
Q["patient_provider_contact_time"] = "WITH " + PATIENT + ",\n" + PROVIDER_CTES + PROVIDER_SELECT

CLERK_WITH = ("concat_ws(', ', CASE WHEN with_doctor = 1 THEN 'Doctor' END, "
              "CASE WHEN with_nurse = 1 THEN 'Nurse' END, "
              "CASE WHEN with_patient = 1 THEN 'Patient' END, "
              "CASE WHEN with_relative = 1 THEN 'Relative' END, "
              "CASE WHEN with_ahp = 1 THEN 'Allied Health Professional' END, "
              "CASE WHEN with_other = 1 THEN 'Other' END)")

Q["clerk_clean_log"] = "WITH " + SRC + f""",
l1 AS (SELECT c_custkey * 100 + day AS session_id, c_mktsegment AS role
       {days('c_nationkey < 12')}),
l2 AS (SELECT c_custkey * 100 + day AS session_id, 'N' || CAST(c_nationkey AS VARCHAR) AS role
       {days()}),
c1 AS (
  SELECT s.* EXCLUDE (with_clerk, with_prr), coalesce(l1.role, l2.role) AS role
  FROM src s LEFT JOIN l1 ON s.session_id = l1.session_id
             LEFT JOIN l2 ON s.session_id = l2.session_id
),
c2 AS (
  SELECT *, {DERIVED},
         coalesce(NULLIF({CLERK_WITH}, ''), 'No one') AS with_whom,
         coalesce(NULLIF({HOW_LABEL}, ''), 'None') AS how
  FROM c1
),
{norm_ctes('c2')}
SELECT * FROM out"""

Q["polyclinic_clean_log"] = "WITH " + SRC + f""",
lp AS (SELECT c_custkey * 100 + day AS session_id,
              CASE WHEN c_acctbal > 5000 THEN c_name END AS participant_id_2,
              c_mktsegment AS role {days()}),
j AS (
  SELECT s.* EXCLUDE (participant_id),
         coalesce(lp.participant_id_2, s.participant_id) AS participant_id, lp.role
  FROM src s LEFT JOIN lp ON s.session_id = lp.session_id
),
d AS (
  SELECT * REPLACE (CASE WHEN what = 'signup' THEN 'sign-up' ELSE what END AS what), {DERIVED}
  FROM j
),
k AS (
  SELECT *, NULLIF({WITH_LABEL}, '') AS with_whom, NULLIF({HOW_LABEL}, '') AS how
  FROM d WHERE session_id NOT IN (1003, 1104, 1205)
),
{norm_ctes('k')}
SELECT * FROM out"""


# --- variants of the staff chain ---------------------------------------------

Q["clean_log_salted"] = Q["clean_log"]
Q["renumber_listed_sessions"] = with_clean(
    f"SELECT {CLEAN_COLS.replace('task_order', 'CASE WHEN session_id IN (802, 902, 1101, 1203) THEN row_number() OVER (PARTITION BY session_id ORDER BY activity_id) ELSE task_order END AS task_order')} FROM clean")


def changed(sql: str, *steps: tuple[str, str]) -> str:
    for old, new in steps:
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


EARLY = "(day(CAST(session_date AS DATE)) <= 15)"
CLEAN_TWO = changed(
    CLEAN,
    ("CASE WHEN session_id = 801 THEN 802 ELSE session_id END AS session_id)",
     f"CASE WHEN session_id = 801 AND {EARLY} THEN 802 ELSE session_id END AS session_id,\n"
     f"    activity_id + CASE WHEN {EARLY} THEN 0 ELSE 144115188075855872 END AS activity_id)"),
    ("CASE WHEN session_id = 802 THEN 32400", f"CASE WHEN session_id = 802 AND {EARLY} THEN 32400"),
    ("CASE WHEN session_id = 802 THEN 79200", f"CASE WHEN session_id = 802 AND {EARLY} THEN 79200"),
    ("LEFT JOIN lk ON fix2.session_id = lk.session_id)",
     f"LEFT JOIN lk ON fix2.session_id = lk.session_id WHERE {EARLY} OR lk.role IS NOT NULL)"))
Q["clean_log_two_exports"] = Q["clean_log"].replace(CLEAN, CLEAN_TWO)
Q["location_summary_first_two_exports"] = Q["location_summary_first"].replace(CLEAN, CLEAN_TWO)

CLEAN_TABLES = changed(
    CLEAN,
    ("CASE WHEN session_id = 1203 THEN 'GL 16' WHEN session_id = 1101 THEN 'GL14'\n"
     "                ELSE participant_id END AS participant_id",
     "coalesce((SELECT max(c_name) FROM customer WHERE c_acctbal < 0\n"
     "                    AND c_custkey * 100 + 15 = joined.session_id),\n"
     "                  CASE WHEN session_id = 1203 THEN 'GL 16' WHEN session_id = 1101 THEN 'GL14'\n"
     "                       ELSE participant_id END) AS participant_id"),
    ("WHERE session_id NOT IN (1003, 1104) AND task_id <> '1_801_7'",
     "WHERE session_id NOT IN (1003, 1104)\n"
     "    AND session_id NOT IN (SELECT c_custkey * 100 + 20 FROM customer WHERE c_nationkey = 3)\n"
     "    AND task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM src WHERE comments = 'c45')"))
Q["clean_log_from_tables"] = Q["clean_log"].replace(CLEAN, CLEAN_TABLES)

CLEAN_NOTEBOOK = changed(
    CLEAN,
    ("CASE WHEN session_id = 902 THEN 43276 ELSE session_end_sec END\n                    AS session_end_sec",
     "CASE WHEN session_id IN (802, 902, 1203)\n"
     "                         THEN renumbered ELSE task_order END AS task_order"),
    ("  FROM der\n", "  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY activity_id)\n"
                      "                AS renumbered\n"
                      "        FROM der WHERE session_id NOT IN (1003, 1104) AND task_id <> '1_801_7') der\n"),
    (f"NULLIF({WITH_LABEL}, '') AS with_whom", f"coalesce(NULLIF({WITH_LABEL}, ''), 'No one') AS with_whom"),
    (f"NULLIF({HOW_LABEL}, '') AS how", f"coalesce(NULLIF({HOW_LABEL}, ''), 'None') AS how"))
Q["notebook_clean_log"] = Q["clean_log"].replace(CLEAN, CLEAN_NOTEBOOK)

# --- presentation forms -------------------------------------------------------

SLICE = "CASE WHEN grouping(role) = 1 THEN 'All' ELSE role END AS role_slice"
Q["tool_by_location_by_role"] = with_clean(
    f"SELECT {SLICE}, location, {tool_cols()} FROM clean WHERE {TOOL_USED} "
    f"GROUP BY GROUPING SETS ((role, location), (location))")
Q["location_summary_by_role"] = with_clean(f"""
SELECT {SLICE}, location, {ndist('session_id')} AS n_sessions, {r(prop_sum(X), 2)} AS total_time_min,
       string_agg(DISTINCT coalesce(what, 'NA'), ', ' ORDER BY coalesce(what, 'NA'))
         AS activities_list
FROM clean GROUP BY GROUPING SETS ((role, location), (location))""")
Q["location_matrix_shown"] = f"""SELECT role_slice, what, total_time, n_act, corridors,
       CASE WHEN role_slice <> 'AUTOMOBILE' THEN other END AS other
FROM ({Q['location_matrix_by_role']}) m WHERE role_slice IN ('All', 'BUILDING', 'AUTOMOBILE')"""
Q["role_slice_activity_share"] = with_clean(f"""
SELECT what AS activity, {r('t', 2)} AS time_min, {r('sum(t) OVER ()', 1)} AS share_min FROM g""",
    f"g AS (SELECT what, coalesce(sum({X}), 0) AS t FROM clean WHERE role = 'BUILDING' GROUP BY what)")
Q["union_filling"] = with_clean("""
SELECT what, location, count(*) AS n FROM clean GROUP BY what, location
UNION ALL SELECT NULL, NULL, count(*) FROM clean""")


def placed(name: str, key: str, order: str) -> str:
    return (f"SELECT '{name}' AS table_name, row_number() OVER (ORDER BY {order}) AS place, "
            f"CAST({key} AS VARCHAR) AS key FROM ({Q[name]}) t")


Q["report_row_order"] = "\nUNION ALL\n".join([
    placed("activity_summary", "what", "total_time_min DESC NULLS LAST, what NULLS LAST"),
    placed("location_summary", "location", "total_time_min DESC NULLS LAST, location NULLS LAST"),
    placed("tool_by_activity", "what", "total_time DESC NULLS LAST, what NULLS LAST"),
    placed("location_matrix", "what", "total_time DESC NULLS LAST, what NULLS LAST"),
    changed(placed("headcount_by_role", "metric", "count DESC NULLS LAST, metric NULLS LAST"),
            (ROLE_LABEL.format(default="role"), "role")),
    changed(placed("dataset_overview", "metric",
                   "CASE metric WHEN 'Unique sessions' THEN 0 WHEN 'Unique observers' THEN 1 "
                   "WHEN 'Unique HCWs' THEN 2 ELSE 3 END, "
                   "CASE WHEN metric LIKE 'Unique%' THEN NULL ELSE count END DESC NULLS LAST, "
                   "metric NULLS LAST"),
            (ROLE_LABEL.format(default="role"), "role")),
    placed("waiting_time", "session_id", "session_id, waiting_time_min DESC NULLS LAST"),
    placed("provider_contact_time", "session_id", "session_id, dr_nurse_min DESC NULLS LAST")])

# --- report bundles as lines --------------------------------------------------

TEXT = {"observer_id", "sessions", "total_sessions", "total_time_hms", "what", "subcategory",
        "location", "session_id", "session_date", "time_slot", "participant_id",
        "session_start_sec", "session_end_sec", "total_session_sec", "total_session_hms",
        "task_order", "with_whom", "how", "comments", "role_slice", "metric", "count", "tool",
        "n_act", "n_sessions", "activities_list", "pct_label", "display_rank", "sheet_name",
        "description"}


def lines(sheet: str, sql: str, columns: str, text: tuple[str, ...] = ()) -> str:
    """The sheet's rows as text, cells in the order of the columns' names."""
    cells = [f"coalesce(CAST({c} AS VARCHAR), 'NA')" if c in TEXT or c in text
             else f"coalesce(CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR), 'NA')"
             for c in sorted(columns.split())]
    return f"SELECT '{sheet}' AS sheet, concat_ws('|', {', '.join(cells)}) AS line FROM ({sql}) t"


OBSERVER = ("observer_id sessions n_activities_avg avg_session_min total_time_min total_time_sec "
            "total_time_hms")
ACTIVITY = "what total_sessions total_time_min avg_time_min max_time_min min_time_min pct_time"
TIMES = ("session_date observer_id time_slot session_id participant_id session_start_sec "
         "session_end_sec")
DETAIL = "session_id observer_id task_order what location with_whom comments"

SHEET_TEXT = {
    "observer_summary": "Per observer: sessions, mean activities per session, mean session "
                        "minutes, total activity minutes and time, with a Total row",
    "sessions_times": "Per session: date, observer, time slot, participant, start, end and "
                      "total time",
    "activity_summary": "Per activity: sessions, total / mean / max / min minutes and share "
                        "of all time",
    "session_detail": "Per activity row: session, observer, order, category, place, "
                      "companions, tools, comments and minutes / seconds",
    "waiting_time_session": "Per session that waited: waiting minutes and their share of the "
                            "session",
    "with_dr_nurse_time": "Per session: minutes with a doctor or nurse and their share of the "
                          "session (0 when none)",
}


def catalog(names: list[str]) -> str:
    rows = ", ".join(f"('{n}', '{SHEET_TEXT[n]}')" for n in names)
    return f"SELECT * FROM (VALUES {rows}) v(sheet_name, description)"


def bundle(clean_ctes: str, times: str, times_columns: str, how: str = " how",
           more: tuple[tuple[str, str, str], ...] = ()) -> str:
    """The script bundles' sheets over a ``clean`` table."""
    def over(name: str) -> str:
        return changed(Q[name], (CLEAN, clean_ctes))

    detail = over("session_detail") if how else changed(over("session_detail"), ("with_whom, how,", "with_whom,"))
    sheets = [("observer_summary", over("observer_summary"), OBSERVER, ("total_time_sec",)),
              ("sessions_times", over(times), times_columns, ()),
              ("activity_summary", over("activity_summary"), ACTIVITY, ()),
              ("session_detail", detail, DETAIL + how + " total_activity_min total_time_sec", ()),
              *((n, over(q), c, ()) for n, q, c in more)]
    names = [s[0] for s in sheets]
    return "\nUNION ALL\n".join([lines("report_summary", catalog(names), "sheet_name description"),
                                 *(lines(*s) for s in sheets)])


HMS_TIMES = TIMES + " total_session_sec total_session_hms"
CLERK = Q["clerk_clean_log"][len("WITH "):Q["clerk_clean_log"].rindex("\nSELECT * FROM out")] \
    + ",\nclean AS (SELECT * FROM out)"
Q["staff_bundle"] = bundle(CLEAN, "session_times", HMS_TIMES)
Q["clerk_bundle"] = bundle(CLERK, "session_minutes", TIMES + " total_session_min")
Q["patient_bundle"] = bundle(PATIENT, "session_times", HMS_TIMES, "", (
    ("waiting_time_session", "waiting_time",
     "session_id what waiting_time_min total_session_min waiting_pct"),
    ("with_dr_nurse_time", "provider_contact_time",
     "session_id dr_nurse_min total_session_min dr_nurse_pct")))

TOOL_NAMES = [("paper_time", "Paper Time"), ("computer_time", "Computer Time"),
              ("mobile_time", "Mobile Time"), ("phone_time", "Phone Time")]
FIRST_BY_ROLE = with_clean(f"""
SELECT a.role_slice, a.location, a.n_sessions, a.total_time_min, l.activities_list
FROM a LEFT JOIN l ON a.location IS NOT DISTINCT FROM l.location
                  AND a.role_slice IS NOT DISTINCT FROM l.role_slice""", f"""
a AS (SELECT {SLICE}, location, {ndist('session_id')} AS n_sessions,
             {r(prop_sum(X), 2)} AS total_time_min
      FROM clean GROUP BY GROUPING SETS ((role, location), (location))),
f AS (SELECT {SLICE}, location, coalesce(what, 'NA') AS item, min(activity_id) AS first_id
      FROM clean GROUP BY GROUPING SETS ((role, location, coalesce(what, 'NA')),
                                         (location, coalesce(what, 'NA')))),
l AS (SELECT role_slice, location, string_agg(item, ', ' ORDER BY first_id) AS activities_list
      FROM f GROUP BY role_slice, location)""")
OVER_ROLES = ("All", "BUILDING", "AUTOMOBILE")


def overview(clean_ctes: str, slices: bool, shown: list[str], heat: list[str], hide: str) -> str:
    """The notebooks' tables, with role slices or of all rows alone."""
    def over(sql: str) -> str:
        sql = changed(sql, (CLEAN, clean_ctes))
        keep = ", ".join(f"'{s}'" for s in OVER_ROLES)
        return f"SELECT * FROM ({sql}) s WHERE role_slice IN ({keep})" if slices else sql

    def either(name: str) -> str:
        return over(Q[name + ("_by_role" if slices else "")])

    part = "role_slice " if slices else ""
    ids = "role_slice, what" if slices else "what"
    hidden = hide or "FALSE"
    matrix = either("location_matrix")
    tools = either("tool_by_activity")
    if slices:
        head = changed(Q["dataset_overview"], (CLEAN, clean_ctes),
                       (ROLE_LABEL.format(default="role"), ROLE_LABEL.format(
                           default="'- ' || coalesce(role, 'NA')")),
                       ("SELECT DISTINCT participant_id, role", "SELECT DISTINCT participant_id, session_id, role"))
        summary = over(Q["activity_summary_by_role"])
    else:
        head = changed(Q["dataset_overview"], (CLEAN, clean_ctes))
        head = head[:head.rindex("\nUNION ALL SELECT")]
        summary = (f"SELECT * FROM ({changed(Q['activity_summary_by_role'], (CLEAN, clean_ctes))}) s "
                   f"WHERE role_slice = 'All'")
    away = {c: f"CASE WHEN NOT ({hidden}) OR '{c}' <> 'other' THEN {c} END" for c, _ in EVENT_LOCS}
    cells = ", ".join(f"{away[c]} AS {c}" for c in shown)
    long = long_form("m", ids, [(c, c) for c in heat], "location")
    long = (f"WITH m AS (SELECT {ids}, {', '.join(f'{away[c]} AS {c}' for c in heat)} FROM ({matrix}) x) "
            f"SELECT * FROM ({long}) y WHERE minutes IS NOT NULL")
    sheets = [
        ("dataset_overview", head, "metric count"),
        ("observer_statistics", changed(Q["observer_summary_brief"], (CLEAN, clean_ctes)),
         "observer_id sessions n_activities_avg avg_time_min"),
        ("activity_summary", summary, part + ACTIVITY + " avg_act_session"),
        ("activity_share", either("activity_share"),
         part + "what activity_time pct_time pct_label display_rank activity_total_min"),
        ("subcategory_share", changed(Q["subcategory_share"], (CLEAN, clean_ctes)),
         "what subcategory activity_time pct_time pct_label"),
        ("tool_by_activity", tools, part + "what total_time paper_time computer_time mobile_time phone_time"),
        ("tool_long", f"WITH tt AS ({tools}) " + long_form("tt", ids, TOOL_NAMES, "tool"),
         part + "what tool minutes heat label"),
        ("location_summary", over(FIRST_BY_ROLE if slices else Q["location_summary_first"]),
         part + "location n_sessions total_time_min activities_list"),
        ("location_matrix", f"SELECT {ids}, total_time, n_act, {cells} FROM ({matrix}) x",
         part + "what total_time n_act " + " ".join(shown)),
        ("location_long", long, part + "what location minutes heat label"),
        ("tool_by_location", either("tool_by_location"),
         part + "location total_time paper_time computer_time mobile_time phone_time")]
    if slices:
        sheets.append(("subcategory_share_by_role", either("subcategory_share"),
                       part + "what subcategory activity_time pct_time pct_label"))
    return "\nUNION ALL\n".join(lines(*s) for s in sheets)


Q["overview_bundle"] = overview(CLEAN_NOTEBOOK, True,
                                ["corridors", "workstation", "treatment_room", "other"],
                                ["corridors", "workstation", "treatment_room", "other"],
                                "role_slice = 'AUTOMOBILE'")
Q["clerk_overview"] = overview(CLERK, False, [c for c, _ in EVENT_LOCS], ["workstation", "other"], "")


def oracle_sql() -> dict[str, str]:
    return dict(Q)
