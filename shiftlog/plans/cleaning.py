"""Cleaning chains: exports -> one cleaned, enriched activity log.

One lazy plan per chain: scans, staged corrections, role joins, derived
columns, exclusions, labels and session-relative time.  What a session has once
-- its role, the participant a lookup gives it, the start of its first activity
-- is brought together per session first (one aggregate of the log, combined
map-side, and joins of session rows with the lookups), so the log itself is
joined once.  Statistics and the adaptive plan decide whether that join
broadcasts or shuffles, and split a session that holds much of the log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.functions.timefmt import seconds_to_hms
from shiftlog.operators.cleaning import (Correction, CorrectionTable, apply_corrections,
                                         drop_columns, exclude_keys, recode)
from shiftlog.operators.enrich import (add_labels, derive_times, relative_to, renumber_tasks,
                                       session_relative_time)
from shiftlog.operators.joins import (HOT_ROWS, SALT, _null_safe_left, add_salt, attach_role,
                                      salt_side)
from shiftlog.sources.forms import DROPPED_AFTER_CLEANING, Form, get_form
from shiftlog.sources.records import FILE_BITS, LINE_BITS


@dataclass
class Export:
    """One export to clean: its rows (canonical layout) and how to treat it."""

    df: DataFrame
    require_role: bool = False        # drop rows whose role lookup found nothing
    apply_raw: bool = True            # raw-stage corrections apply to this export


@dataclass
class CleaningConfig:
    dataset: str
    form: str = "staff_v1"
    corrections: Sequence[Correction] = ()
    recodes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    correction_table: CorrectionTable | None = None   # corrections held as data, after those
    exclude_sessions: Sequence[int] | DataFrame = ()
    exclude_tasks: Sequence[str] | DataFrame = ()
    labels: str = "script"            # "script": empty label NULL; "notebook": "No one"/"None"
    relative_keys: Sequence[str] = ("session_id",)
    renumber_sessions: Sequence[int] = ()
    participant_from_lookup: bool = False   # polyclinic notebook: lookup id wins
    salted: bool = False              # spread big sessions by a salt, not by the adaptive plan
    hot_rows: int = HOT_ROWS          # sessions with more rows get one


def _label_empties(cfg: CleaningConfig, f: Form) -> tuple[str | None, str | None]:
    if f.no_one_flag is not None:          # patient form keeps "" for no flag
        return "", None
    if cfg.labels == "notebook":
        return "No one", "None"
    return None, None


def _corrected(df: DataFrame, cfg: CleaningConfig, stage: str) -> DataFrame:
    df = apply_corrections(df, cfg.corrections, stage, cfg.dataset)
    return cfg.correction_table.apply(df, stage) if cfg.correction_table else df


def _fixed_targets(cfg: CleaningConfig, stages: Sequence[str]) -> set[str]:
    """Columns that corrections of the stages may write."""
    steps = [(c.stage, c.target) for c in cfg.corrections if c.dataset == cfg.dataset]
    if cfg.correction_table:
        steps += [(stage, target) for stage, _, target in cfg.correction_table.steps]
    return {target for stage, target in steps if stage in stages}


def _row_steps(df: DataFrame, cfg: CleaningConfig) -> DataFrame:
    """What follows the union row by row: derived columns, their corrections
    and recodes, exclusions, late corrections."""
    df = _corrected(derive_times(df), cfg, "derived")
    for col, mapping in cfg.recodes.items():
        df = recode(df, col, mapping)
    for col, keys in (("session_id", cfg.exclude_sessions), ("task_id", cfg.exclude_tasks)):
        df = exclude_keys(df, col, keys)
    return _corrected(df, cfg, "late")


def _session_facts(df: DataFrame, cfg: CleaningConfig, lookups: Sequence[DataFrame]) -> DataFrame:
    """One row per session (more where a lookup repeats its key): ``role``,
    ``__participant``, ``__origin`` (start of its first kept activity) and
    ``__rows``.

    Rows that require a role are kept in sessions that have one only, so the
    origin of a session without a role is over its other rows.
    """
    start = F.col("start_sec")
    facts = _row_steps(df, cfg).groupBy("session_id").agg(
        F.min(start).alias("__start"), F.count(F.lit(1)).alias("__rows"),
        F.min(F.when(~F.col("__require_role"), start)).alias("__start_free"))
    if not lookups:
        return facts.select("session_id", "__rows", F.col("__start").alias("__origin"))
    # a struct matches null-safely, and leaves the session itself unshuffled for
    # the log's join: the adaptive plan splits skew only between two exchanges
    key = F.struct(F.col("session_id").cast("bigint")).alias("__key")
    facts = facts.select("*", key)
    if cfg.participant_from_lookup:
        lk = lookups[0].select(key, "role", F.col("participant_id_2").alias("__participant"))
        facts = facts.join(lk, "__key", "left")
    else:
        facts = attach_role(facts, [lk.select(key, "role") for lk in lookups], "__key") \
            .withColumn("__participant", F.lit(None).cast("string"))
    origin = F.when(F.col("role").isNull(), F.col("__start_free")).otherwise(F.col("__start"))
    return facts.select("session_id", "__rows", "role", "__participant", origin.alias("__origin"))


def clean_log(exports: Sequence[Export], cfg: CleaningConfig,
              lookups: DataFrame | Sequence[DataFrame] | None = None) -> DataFrame:
    """Run the cleaning chain over one or more exports of the same site.

    Stages, in the reference's order: raw corrections -> strict union by
    name -> role join (and the per-export known-role filter) -> derived
    columns -> derived-stage corrections and recodes -> exclusions -> late
    corrections (derived columns stay as they were) -> task renumbering ->
    labels -> session-relative time -> normalised-stage corrections -> drop
    of the multitask / interruption block.

    ``activity_id`` of several exports is renumbered by the place of the
    export in the list, so row order is that of the union and ids are unique.

    The role and the origin of relative times reach the log in one join on
    the session (:func:`_session_facts`), null-safe as the reference's joins
    are.  That needs the session a row has before and after its corrections
    to be the same; where a later correction changes session ids, or origins
    are per clock pair, the origin is an aggregate and a join of its own.
    ``cfg.salted`` keys the join on (session, salt) for sessions above
    ``cfg.hot_rows`` rows.
    """
    f = get_form(cfg.form)
    if cfg.correction_table:
        cfg.correction_table.check()
    parts = []
    for i, ex in enumerate(exports):
        d = ex.df
        if ex.apply_raw:
            d = _corrected(d, cfg, "raw")
        if len(exports) > 1 and "activity_id" in d.columns:
            place = FILE_BITS + LINE_BITS
            own = F.col("activity_id").bitwiseAND(F.lit((1 << place) - 1))
            d = d.withColumn("activity_id", own + F.lit(i << place).cast("bigint"))
        parts.append(d.withColumn("__require_role", F.lit(bool(ex.require_role))))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    lookups = [] if lookups is None else [lookups] if isinstance(lookups, DataFrame) else list(lookups)
    log_columns = [c for c in df.columns if c not in ("__require_role", "role")]

    facts = _session_facts(df, cfg, lookups)
    if cfg.salted:
        hot = facts.where(F.col("__rows") > cfg.hot_rows).select("session_id").distinct()
        df = add_salt(df, hot, ["session_id"])
        df = _null_safe_left(df, salt_side(facts.drop("__rows"), hot, ["session_id"]),
                             ["session_id"], [SALT])
    else:
        df = _null_safe_left(df, facts.drop("__rows"), ["session_id"])
    if lookups:
        df = df.where(~F.col("__require_role") | F.col("role").isNotNull())
        if cfg.participant_from_lookup:
            df = df.withColumn("participant_id", F.coalesce("__participant", "participant_id"))
    df = _row_steps(df.select(*log_columns, *(["role"] if lookups else []), "__origin"), cfg)
    if cfg.renumber_sessions:
        df = renumber_tasks(df, cfg.renumber_sessions)
    empty_with, empty_how = _label_empties(cfg, f)
    df = add_labels(df, f.with_flags, f.how_flags, empty_with, empty_how, f.no_one_flag)
    if (list(cfg.relative_keys) == ["session_id"]
            and not {"session_id", "start_sec"} & _fixed_targets(cfg, ("derived", "late"))):
        df = relative_to(df, "__origin")
    else:
        df = session_relative_time(df.drop("__origin"), cfg.relative_keys, hot_rows=cfg.hot_rows)
    if "normalised" in _stages(cfg):
        df = _corrected(df, cfg, "normalised").withColumns(
            {"start_norm_hms": seconds_to_hms("start_norm_sec"),
             "end_norm_hms": seconds_to_hms("end_norm_sec")})
    return drop_columns(df, DROPPED_AFTER_CLEANING)


def _stages(cfg: CleaningConfig) -> set[str]:
    stages = {c.stage for c in cfg.corrections if c.dataset == cfg.dataset}
    return stages | {s for s, _, _ in cfg.correction_table.steps} if cfg.correction_table else stages


def clean_polyclinic_log(exports: Sequence[Export], cfg: CleaningConfig,
                         lookup: DataFrame) -> DataFrame:
    """Polyclinic chain: :func:`clean_log` with a lookup holding
    ``session_id, role, participant_id_2``; with ``participant_from_lookup``
    the lookup's participant id replaces the logged one when present (the
    same join that brings the role)."""
    return clean_log(exports, cfg, lookup)
