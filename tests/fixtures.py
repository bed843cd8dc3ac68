"""Synthetic export files in the reference's raw layouts (no real rows)."""

from __future__ import annotations

import csv
import io

from shiftlog.sources.forms import get_form

# One synthetic staff session set covering the edge rows of FIXTURES.md.
STAFF_ROWS = [
    # obs, session, task, participant, date, s_start, s_end, start, end, total, active,
    # what, sub, where, comments, with flags (8), how flags (4)
    (1, 501, "1_501_1", "A1", "2025-03-23", "08:00:00", "09:00:00", "08:00:00", "08:10:00",
     "00:10:00", "00:10:00", "Direct Care", "Exam", "Treatment Room", "", 1, 0, 0, 0, 1, 0, 0, 0,
     1, 0, 0, 0),
    (1, 501, "1_501_2", "A1", "2025-03-23", "08:00:00", "09:00:00", "08:10:00", "08:30:00",
     "00:20:00", "00:20:00", "Inter-Professional Communication", "0", "Corridors", "note", "", 1,
     0, 0, 0, 0, 0, 0, 0, 1, 0, 1),
    # duplicate activity row
    (1, 501, "1_501_2", "A1", "2025-03-23", "08:00:00", "09:00:00", "08:10:00", "08:30:00",
     "00:20:00", "00:20:00", "Inter-Professional Communication", "0", "Corridors", "note", "", 1,
     0, 0, 0, 0, 0, 0, 0, 1, 0, 1),
    # session past midnight, NULL total time, all flags set
    (2, 502, "2_502_1", "", "2025-03-24", "22:00:00", "24:36:20", "22:05:00", "23:05:00",
     "", "01:00:00", "Waiting Time", "0", "Waiting Area", "", 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1),
    # task id without a trailing number, no flag set, excluded session
    (2, 503, "odd", "B2", "2025-03-25", "13:00:00", "14:00:00", "13:00:00", "13:30:00",
     "00:30:00", "00:30:00", "Other Indiret Care", "Request Tests(Lab, Img, etc)", "", "",
     0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    # same clock pair as 501 on another date
    (3, 504, "3_504_7", "C3", "2025-03-26", "08:00:00", "09:00:00", "08:20:00", "08:50:00",
     "00:30:00", "00:30:00", "Direct Care", "Exam", "Treatment Room", "", 0, 1, 0, 0, 0, 0, 0, 0,
     0, 1, 0, 0),
]


ROW_KEYS = ["observer_id", "session_id", "task_id", "participant_id", "session_date",
            "session_start_sec", "session_end_sec", "start_sec", "end_sec", "total_sec",
            "active_sec", "what", "subcategory", "location", "comments",
            "with_doctor", "with_nurse", "with_clerk", "with_prr", "with_patient",
            "with_relative", "with_ahp", "with_other",
            "how_paper", "how_desktop", "how_mobile", "how_phone"]


def staff_csv(form: str = "staff_v1", rows=STAFF_ROWS) -> str:
    f = get_form(form)
    head = f.raw_names
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(head)
    canon = [c for _, c, _ in f.columns]
    for r in rows:
        vals = dict(zip(ROW_KEYS, [("" if v is None else v) for v in r]))
        w.writerow([vals.get(c, "") for c in canon])
    return out.getvalue()


def lookup_csv() -> bytes:
    """Hospital-style lookup: ';' separated, UTF-8 BOM, CRLF, padded fields."""
    text = ("healthcare_work_id_v2;session id;health_professional_v2;health_professional_desc\r\n"
            "W1; 501 ;1; Nurse \r\n"
            "W2;502;2;Physician\r\n"
            "W3;504;3;\r\n")
    return "﻿".encode() + text.encode("utf-8")
