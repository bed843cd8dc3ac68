"""Cleaning configurations.

``REFERENCE_*``: the corrections, recodes and exclusions the reference's
scripts apply to their own exports, held as data.  ``EVENTS``: the same
kinds of fixes aimed at the activity log derived from the test tables,
so every stage of the chain changes some rows there.
"""

from __future__ import annotations

from dataclasses import replace

from shiftlog.operators.cleaning import Correction
from shiftlog.plans.cleaning import CleaningConfig
from shiftlog.plans.reports import Overview

# Category spellings the reference corrects.
STAFF_RECODES = {
    "what": {"Inter-Professional Communication": "Professional Communication"},
    "subcategory": {"Request Tests(Lab, Img, etc)": "Request Tests (Lab, Img, etc)",
                    "Other Indiret Care": "Other Indirect Care"},
}

# The reference's hospital staff corrections (session ids,
# clock values in seconds, participant codes) and exclusions.
REFERENCE_HOSPITAL_STAFF = CleaningConfig(
    dataset="hospital_staff",
    form="staff_v1",
    corrections=[
        Correction("hospital_staff", "raw", "session_id", 10202, "session_id", 10203),
        Correction("hospital_staff", "raw", "session_id", 10203, "session_start_sec", 51660),
        Correction("hospital_staff", "raw", "session_id", 10203, "session_end_sec", 64065),
        Correction("hospital_staff", "derived", "session_id", 10226, "participant_id", "GL 16"),
        Correction("hospital_staff", "derived", "session_id", 10223, "participant_id", "GL14"),
        Correction("hospital_staff", "late", "session_id", 10260, "session_end_sec", 43276),
    ],
    recodes=STAFF_RECODES,
    exclude_sessions=[10195, 10180, 10184, 10189],
    exclude_tasks=["10175_10260_60"],
)

# The hospital notebook's own chain (labels, one session's tasks
# renumbered, no late fix of session 10260).
REFERENCE_HOSPITAL_NOTEBOOK = replace(
    REFERENCE_HOSPITAL_STAFF,
    corrections=[c for c in REFERENCE_HOSPITAL_STAFF.corrections if c.stage != "late"],
    labels="notebook", renumber_sessions=[10203])

# The polyclinic's exclusions, in its script and its notebook.
REFERENCE_POLYCLINIC_STAFF = CleaningConfig(
    dataset="polyclinic_staff",
    form="staff_v1",
    recodes=STAFF_RECODES,
    exclude_sessions=[10398, 10360, 10195],
)

REFERENCE_POLYCLINIC_NOTEBOOK = replace(
    REFERENCE_POLYCLINIC_STAFF, exclude_sessions=[10398, 10360], labels="notebook",
    participant_from_lookup=True)

REFERENCE_CLERK = CleaningConfig(dataset="clerk", form="clerk")
REFERENCE_CLERK_NOTEBOOK = replace(REFERENCE_CLERK, labels="notebook")

# The patient log's corrections.
REFERENCE_PATIENT = CleaningConfig(
    dataset="patient",
    form="patient",
    corrections=[
        Correction("patient", "raw", "session_id", 10320, "participant_id", "TL8"),
        Correction("patient", "raw", "session_id", 10300, "session_end_sec", 88580),
        Correction("patient", "normalised", "session_id", 10300, "end_norm_sec", 13828),
    ],
)

# Activity log derived from `events` (see shiftlog.sources.testlog).
EVENTS = CleaningConfig(
    dataset="events",
    form="staff_v1",
    corrections=[
        Correction("events", "raw", "session_id", 801, "session_id", 802),
        Correction("events", "raw", "session_id", 802, "session_start_sec", 32400),
        Correction("events", "raw", "session_id", 802, "session_end_sec", 79200),
        Correction("events", "derived", "session_id", 1203, "participant_id", "GL 16"),
        Correction("events", "derived", "session_id", 1101, "participant_id", "GL14"),
        Correction("events", "late", "session_id", 902, "session_end_sec", 43276),
    ],
    recodes={"what": {"signup": "sign-up"}, "subcategory": {"S4": "S 4"}},
    exclude_sessions=[1003, 1104],
    exclude_tasks=["1_801_7"],
)

# The other chains over the same events-derived log.
EVENTS_PATIENT = CleaningConfig(
    dataset="events_patient",
    form="patient",
    corrections=[
        Correction("events_patient", "raw", "session_id", 1203, "participant_id", "TL8"),
        Correction("events_patient", "raw", "session_id", 902, "session_end_sec", 88580),
        Correction("events_patient", "normalised", "session_id", 902, "end_norm_sec", 13828),
    ],
)

EVENTS_CLERK = CleaningConfig(dataset="events_clerk", form="clerk", labels="notebook")

# The hospital notebook's kind of chain.
EVENTS_NOTEBOOK = replace(EVENTS, corrections=[c for c in EVENTS.corrections if c.stage != "late"],
                          labels="notebook", renumber_sessions=[802, 902, 1203])

EVENTS_POLYCLINIC = CleaningConfig(
    dataset="events_polyclinic",
    form="staff_v1",
    recodes={"what": {"signup": "sign-up"}},
    exclude_sessions=[1003, 1104, 1205],
    participant_from_lookup=True,
)

# Location columns of the reference's hospital matrix
# (column name, location text), and of the events log.
HOSPITAL_LOCATIONS = [
    ("corridors", "Corridors"), ("workstation", "Doctor/Nurse WorkStation"),
    ("observation_room", "Observation Room"), ("triage_area", "Screening/Triage Area"),
    ("treatment_room", "Treatment Room"), ("other", "Other"),
    ("ambulance_bay", "Ambulance Bay"), ("waiting_area", "Waiting Area"),
    ("xray_ct", "X Ray/CT San Unit"), ("registration", "Registration"),
    ("plaster_room", "Plaster Room"), ("medication_room", "Medication Room"),
    ("consultation_room", "Consultation Room"),
]

# Location columns of the clerks' matrix.
CLERK_LOCATIONS = [
    ("reception_desk", "Reception Desk"), ("other", "Other"), ("waiting_area", "Waiting Area"),
    ("hallway", "Hallway"), ("nurse_station", "Nurse Station"), ("triage_area", "Triage Area"),
    ("treatment_room", "Treatment Room"),
]
EVENT_LOCATION_COLUMNS = [("corridors", "Corridors"), ("workstation", "Workstation"),
                          ("treatment_room", "Treatment Room"), ("waiting_area", "Waiting Area"),
                          ("other", "Other")]
LINEITEM_LOCATION_COLUMNS = [("treatment_room", "Treatment Room"), ("corridors", "Corridors")]

# Report labels of roles in the headcount rows.
HOSPITAL_ROLE_LABELS = {"Nurse": "- Nurses", "Physician": "- Physicians", "Other": "- Others"}
EVENT_ROLE_LABELS = {"BUILDING": "- Building", "AUTOMOBILE": "- Automobile"}

# What the notebooks show of the location matrix, how they label
# roles and what they count heads by.
HOSPITAL_OVERVIEW = Overview(
    HOSPITAL_LOCATIONS,
    shown=["corridors", "workstation", "observation_room", "triage_area", "treatment_room",
           "other", "ambulance_bay", "waiting_area", "registration", "medication_room",
           "consultation_room"],
    hidden={"Physician": ["ambulance_bay", "consultation_room"]}, role_labels=HOSPITAL_ROLE_LABELS)
POLYCLINIC_OVERVIEW = Overview(
    HOSPITAL_LOCATIONS,
    shown=["corridors", "workstation", "observation_room", "triage_area", "treatment_room",
           "other", "ambulance_bay", "waiting_area", "registration", "consultation_room"],
    hidden={"Physician": ["ambulance_bay"]}, role_labels=HOSPITAL_ROLE_LABELS,
    head_keys=("participant_id", "session_id"), prefix_others="- ")
CLERK_OVERVIEW = Overview(
    CLERK_LOCATIONS, heat=["other", "waiting_area", "hallway", "nurse_station", "triage_area",
                           "treatment_room"], role=None)
EVENT_OVERVIEW = Overview(
    EVENT_LOCATION_COLUMNS, shown=["corridors", "workstation", "treatment_room", "other"],
    hidden={"AUTOMOBILE": ["other"]}, roles=("BUILDING", "AUTOMOBILE"),
    role_labels=EVENT_ROLE_LABELS, head_keys=("participant_id", "session_id"), prefix_others="- ")
EVENT_CLERK_OVERVIEW = Overview(EVENT_LOCATION_COLUMNS, heat=["workstation", "other"], role=None)
