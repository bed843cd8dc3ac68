"""Report bundles: named report tables built from one cleaned log.

A bundle is a ``dict[str, DataFrame]``; :func:`write_bundle` writes the
processed log once to the shared folder, builds every table from that
written copy (so the cleaning plan runs once and a lost executor only
re-reads files), then writes one dataset per table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from shiftlog.operators import breakdowns as B
from shiftlog.operators import summaries as S
from shiftlog.sources.sinks import report_catalog, write_processed, write_report

# Descriptions of the sheets each bundle holds (our wording).
SHEETS = {
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


def _catalog(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return report_catalog(spark, [(n, SHEETS[n]) for n in names])


def staff_bundle(log: DataFrame, clerk: bool = False) -> dict[str, DataFrame]:
    """Doctor / nurse (and polyclinic) report bundle; ``clerk=True`` gives
    the clerk variant whose session sheet carries session minutes."""
    sessions = S.session_minutes(log) if clerk else S.session_times(log)
    out = {
        "observer_summary": S.observer_summary(log),
        "sessions_times": sessions,
        "activity_summary": S.activity_summary(log),
        "session_detail": S.session_detail(log),
    }
    return {"report_summary": _catalog(log.sparkSession, list(out)), **out}


def patient_bundle(log: DataFrame, waiting_value: str = "Waiting Time",
                   provider_pattern: str = "Nurse|Doctor") -> dict[str, DataFrame]:
    """Patient bundle: the staff tables (no tool column in the detail),
    plus waiting time and provider-contact time per session."""
    detail_cols = [c for c in S.DETAIL_COLS if c != "how"]
    out = {
        "observer_summary": S.observer_summary(log),
        "sessions_times": S.session_times(log),
        "activity_summary": S.activity_summary(log),
        "session_detail": S.session_detail(log, detail_cols),
        "waiting_time_session": S.waiting_time(log, waiting_value),
        "with_dr_nurse_time": S.provider_contact_time(log, provider_pattern),
    }
    return {"report_summary": _catalog(log.sparkSession, list(out)), **out}


@dataclass(frozen=True)
class Overview:
    """What a notebook shows: the matrix's locations (``shown``: its columns,
    ``heat``: those of the heat map, by default the shown ones; ``hidden``:
    columns that a role slice leaves out), the role slices besides all rows
    (``role=None``: none) and how the headcount is taken and labelled."""

    locations: Sequence[tuple[str, str]]
    shown: Sequence[str] | None = None
    heat: Sequence[str] | None = None
    hidden: Mapping[str, Sequence[str]] = field(default_factory=dict)
    role: str | None = "role"
    roles: Sequence[str] | None = ("Nurse", "Physician")
    role_labels: Mapping[str, str] = field(default_factory=dict)
    head_keys: Sequence[str] = ("participant_id",)
    prefix_others: str | None = None


def overview_bundle(log: DataFrame, show: Overview) -> dict[str, DataFrame]:
    """Notebook overview tables.  With a role every breakdown carries an
    ``All`` slice and one slice per listed role, from one read per table;
    ``role=None`` gives the all-rows tables only (clerk notebook)."""
    r, roles = show.role, show.roles
    tools = B.tool_time(log, role=r, roles=roles, sort=True)
    columns = [c for c, _ in show.locations]
    matrix = B.location_matrix(log, show.locations, role=r, roles=roles, hidden=show.hidden,
                               sort=True)
    heat = show.heat or show.shown or columns
    out = {
        "dataset_overview": B.dataset_overview(log, role=r, head_keys=show.head_keys,
                                               labels=show.role_labels,
                                               prefix_others=show.prefix_others),
        "observer_statistics": S.observer_summary(log, brief=True),
        "activity_summary": S.activity_summary(log, per_session=True, role=r, roles=roles),
        "activity_share": B.activity_share(log, role=r, roles=roles),
        "subcategory_share": B.subcategory_share(log),
        "tool_by_activity": tools,
        "tool_long": B.tool_long(tools),
        "location_summary": B.location_summary(log, order="first", role=r, roles=roles),
        "location_matrix": matrix.drop(*[c for c in columns if show.shown and c not in show.shown]),
        "location_long": B.location_long(matrix, [x for x in show.locations if x[0] in heat]),
        "tool_by_location": B.tool_time(log, key="location", role=r, roles=roles, sort=True),
    }
    if r:
        out["subcategory_share_by_role"] = B.subcategory_share(log, digits=1, role=r, roles=roles)
    return out


def write_bundle(log: DataFrame, build, base_path: str, processed_path: str | None = None,
                 **kwargs) -> dict[str, str]:
    """Write the processed log, build the bundle from the written copy and
    write every table; returns sheet -> path (processed log as ``processed``)."""
    spark = log.sparkSession
    processed_path = processed_path or f"{base_path.rstrip('/')}/processed"
    write_processed(log, processed_path)
    written = spark.read.schema(log.schema).parquet(processed_path).select(*log.columns)
    paths = write_report(build(written, **kwargs), base_path)
    return {"processed": processed_path, **paths}
