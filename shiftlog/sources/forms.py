"""Activity-log export layouts ("forms") and their canonical column names.

Every export is read with an explicit all-STRING schema in its own header
names, then projected onto one canonical, typed layout (snake_case):

=====================  ======  ===========================================
canonical column       type    meaning
=====================  ======  ===========================================
activity_id            LONG    ingest ordinal (row order of the export)
observer_id            LONG    observer
session_id             LONG    observation session
task_id                STRING  ``observer_session_order`` text
participant_id         STRING  observed person (nullable)
session_date           STRING  date text of the session
session_start_sec      LONG    session start, seconds of day
session_end_sec        LONG    session end, seconds (may pass 86400)
start_sec / end_sec    LONG    activity start / end
total_sec              LONG    activity total time
active_sec             LONG    activity active time
what / subcategory     STRING  activity category / subcategory (``0`` = none)
location               STRING  where it happened
comments               STRING  free text
with_* / how_*         INT     0/1 flags: with whom / which tool
=====================  ======  ===========================================
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StringType, StructField, StructType

# Raw export header names (as written by the recording tool)
# and the canonical name each is read into.
COMMON_COLUMNS = [
    ("observer id", "observer_id", "long"),
    ("session id", "session_id", "long"),
    ("observer/session/task id", "task_id", "string"),
    ("participant id", "participant_id", "string"),
    ("session date", "session_date", "string"),
    ("session start", "session_start_sec", "hms"),
    ("session end", "session_end_sec", "hms"),
    ("start time", "start_sec", "hms"),
    ("end time", "end_sec", "hms"),
    ("elapsed time", "elapsed_sec", "hms"),
    ("total time", "total_sec", "hms"),
    ("active 1", "active_sec", "hms"),
]

TAIL_COLUMNS = [
    ("Where", "location", "string"),
    ("Comments", "comments", "string"),
]

# Multitask / interruption block, read and dropped by every cleaning chain.
DROPPED_BLOCK = [
    ("multi with", "multi_with", "string"),
    ("num of multitask fragments", "n_multitask_fragments", "string"),
    ("total overlapping time", "total_overlapping_time", "string"),
    ("is interrupting task?", "is_interrupting_task", "string"),
    ("interrupted by", "interrupted_by", "string"),
    ("num of interrupts", "n_interrupts", "string"),
]

# Staff (doctor / nurse) flag columns, their canonical names
# and the label each contributes to ``with_whom`` / ``how``.
STAFF_WITH = [
    ("[With Whom] Doctor", "with_doctor", "Doctor"),
    ("[With Whom] Nurse", "with_nurse", "Nurse"),
    ("[With Whom] Clerks", "with_clerk", "Clerks"),
    ("[With Whom] Patient Relation Reps", "with_prr", "Patient Relation Reps"),
    ("[With Whom] Patient", "with_patient", "Patient"),
    ("[With Whom] Relative", "with_relative", "Relative"),
    ("[With Whom] Allied Health Professional", "with_ahp", "Allied Health Professional"),
    ("[With Whom] Other", "with_other", "Other"),
]
HOW = [
    ("[How] Paper Based Record", "how_paper", "Paper"),
    ("[How] Desktop Computer", "how_desktop", "Desktop Computer"),
    ("[How] Mobile Computer", "how_mobile", "Mobile Computer"),
    ("[How] Phone", "how_phone", "Phone"),
]
CLERK_WITH = [
    ("[With Whom] Doctor", "with_doctor", "Doctor"),
    ("[With Whom] Nurse", "with_nurse", "Nurse"),
    ("[With Whom] Patient", "with_patient", "Patient"),
    ("[With Whom] Relative", "with_relative", "Relative"),
    ("[With Whom] Allied Health Professional", "with_ahp", "Allied Health Professional"),
    ("[With Whom] Other", "with_other", "Other"),
]
PATIENT_WITH = [
    ("[With Whom] Doctor", "with_doctor", "Doctor"),
    ("[With Whom] Nurse", "with_nurse", "Nurse"),
    ("[With Whom] Clerk", "with_clerk", "Clerk"),
    ("[With Whom] Patient Relation Rpes", "with_prr", "Patient Relation Reps"),
    ("[With Whom] Relative (Family Member or companion)", "with_relative", "Relative"),
    ("[With Whom] Allied Health Professional", "with_ahp", "Allied Health Professional"),
    ("[With Whom] Other", "with_other", "Other"),
]
PATIENT_NO_ONE = ("[With Whom] No one", "with_no_one", "No one")


@dataclass(frozen=True)
class Form:
    """One export layout: ordered raw columns -> canonical name and kind."""

    name: str
    columns: list[tuple[str, str, str]]
    with_flags: list[tuple[str, str]]          # (canonical flag, label)
    how_flags: list[tuple[str, str]] = field(default_factory=list)
    no_one_flag: tuple[str, str] | None = None
    dropped: tuple[str, ...] = ()              # canonical names dropped at ingest

    @property
    def raw_names(self) -> list[str]:
        return [r for r, _, _ in self.columns]

    def raw_schema(self) -> StructType:
        return StructType([StructField(r, StringType(), True) for r in self.raw_names])


def _what(label: str) -> list[tuple[str, str, str]]:
    return [(f"What ({label})", "what", "string"),
            (f"What ({label}) (subcategories)", "subcategory", "string")]


def _flags(spec) -> list[tuple[str, str, str]]:
    return [(raw, canon, "int") for raw, canon, _ in spec]


def _labels(spec) -> list[tuple[str, str]]:
    return [(canon, label) for _, canon, label in spec]


_STAFF_V2_WITH = [(r.replace("Clerks", "Clerk"), c, lbl) for r, c, lbl in STAFF_WITH]

FORMS: dict[str, Form] = {
    "staff_v1": Form(
        "staff_v1",
        COMMON_COLUMNS + _what("DR-NURSE") + TAIL_COLUMNS + _flags(STAFF_WITH)
        + _flags(HOW) + DROPPED_BLOCK,
        _labels(STAFF_WITH), _labels(HOW)),
    "staff_v2": Form(
        "staff_v2",
        COMMON_COLUMNS + _what("DR-NURSE v2") + TAIL_COLUMNS + _flags(_STAFF_V2_WITH)
        + [("[With Whom] Student", "with_student", "int")]
        + _flags(HOW) + DROPPED_BLOCK
        + [("int task id 1", "int_task_id_1", "string"), ("int start 1", "int_start_1", "string"),
           ("int end 1", "int_end_1", "string"), ("active 2", "active_2", "string"),
           ("inactive 1", "inactive_1", "string")],
        _labels(STAFF_WITH), _labels(HOW),
        dropped=("with_student", "int_task_id_1", "int_start_1", "int_end_1",
                 "active_2", "inactive_1")),
    "clerk": Form(
        "clerk",
        COMMON_COLUMNS + _what("RECORD CLERK") + TAIL_COLUMNS + _flags(CLERK_WITH)
        + _flags(HOW) + DROPPED_BLOCK,
        _labels(CLERK_WITH), _labels(HOW)),
    "patient": Form(
        "patient",
        COMMON_COLUMNS + _what("PATIENT") + TAIL_COLUMNS + _flags(PATIENT_WITH)
        + [(PATIENT_NO_ONE[0], PATIENT_NO_ONE[1], "int")] + DROPPED_BLOCK,
        _labels(PATIENT_WITH), [], (PATIENT_NO_ONE[1], PATIENT_NO_ONE[2])),
}

DROPPED_AFTER_CLEANING = tuple(c for _, c, _ in DROPPED_BLOCK) + ("elapsed_sec",)

# Canonical columns of a cleaned staff log, in output order.
STAFF_FLAGS = [c for _, c, _ in STAFF_WITH] + [c for _, c, _ in HOW]


def get_form(name: str) -> Form:
    try:
        return FORMS[name]
    except KeyError:
        raise ValueError(f"unknown form {name!r}; known: {sorted(FORMS)}") from None
