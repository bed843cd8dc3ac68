"""CSV records against Python's csv module on hand-written and random files,
in splits of a few bytes."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException

from shiftlog.sources.forms import FORMS
from shiftlog.sources.readers import read_activity_log, read_lookup
from shiftlog.sources.records import parse, read_records


@pytest.fixture(params=["40", "134217728"])
def splits(spark, request):
    """Files in splits of 40 bytes, and whole."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def rows_of(spark, path, names, sep=","):
    records = read_records(spark, path, sep)
    got = parse(records, names, [records.ordinal().alias("id")]).orderBy("id").collect()
    assert not any(r["bad"] for r in got)
    assert len({r["id"] for r in got}) == len(got)
    return [tuple(r[n] for n in names) for r in got]


def test_quotes_breaks_and_line_ends(spark, tmp_path, splits):
    path = write(tmp_path / "a", "x.csv", (
        "﻿a,b,c\r\n"
        '1,"said ""wait, here"", left",x\r\n'
        '2,"two\r\nlines, and\r\n\r\na ""third""",y\r\n'
        "\r\n"
        '3,"",NA\r\n'
        '4,  plain  ,"NA"\r\n'
        '5,"""",last'))
    assert rows_of(spark, path, ["a", "b", "c"]) == [
        ("1", 'said "wait, here", left', "x"), ("2", 'two\r\nlines, and\r\n\r\na "third"', "y"),
        ("3", None, None), ("4", "plain", None), ("5", '"', "last")]


def test_every_file_has_its_own_header(spark, tmp_path, splits):
    folder = tmp_path / "lk"
    write(folder, "1.csv", "session id;health_professional_desc\n1;Nurse\n2;Physician\n")
    write(folder, "2.csv", "work;health_professional_desc;session id\n7;Clerk;3\n8;;4\n")
    write(folder, "3.csv", b"\xef\xbb\xbfhealth_professional_desc;session id\r\n Nurse ; 5 \r\nNA;6\r\n")
    write(folder, "4.csv", "")
    got = {(r["session_id"], r["role"]) for r in read_lookup(spark, str(folder)).collect()}
    assert got == {(1, "Nurse"), (2, "Physician"), (3, "Clerk"), (4, None), (5, "Nurse"), (6, None)}
    write(folder, "5.csv", "session id;other\n9;x\n")
    with pytest.raises(ValueError, match="lacks columns"):
        read_lookup(spark, str(folder))


def test_a_short_lookup_record_fails(spark, tmp_path):
    path = write(tmp_path / "lk", "1.csv", "session id;health_professional_desc\n1;Nurse\n2\n")
    with pytest.raises(PySparkException, match="not as many fields"):
        read_lookup(spark, path).collect()


def random_file(rng, n):
    """Rows and their text: quoted at random, breaks, quotes and separators."""
    rows, out = [], io.StringIO()
    writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    every = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
    for i in range(n):
        row = [str(i), "".join(rng.choice('ab,"\n') for _ in range(rng.randrange(12))).strip() or "x", "z"]
        rows.append(tuple(row))
        rng.choice([writer, every]).writerow(row)
    return rows, out.getvalue()


@pytest.mark.parametrize("seed", range(3))
def test_random_files_as_the_csv_module_reads_them(spark, tmp_path, splits, seed):
    rng = random.Random(seed)
    folder, want = tmp_path / f"r{seed}", []
    for f in range(4):
        rows, text = random_file(rng, rng.choice([0, 1, 30]))
        order = rng.choice(["abc", "abc"])
        write(folder, f"{f}.csv", ",".join(order) + "\n" + text)
        want += rows
    assert rows_of(spark, str(folder), ["a", "b", "c"]) == want


HEADER = FORMS["staff_v1"].raw_names


def staff_line(**values):
    base = {"observer id": "1", "session id": "9", "observer/session/task id": "1_9_1",
            "session start": "08:00:00", "session end": "09:00:00", "start time": "08:00:00",
            "end time": "08:05:00", "active 1": "00:05:00", "What (DR-NURSE)": "Care"} | values
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerow([base.get(h, "") for h in HEADER])
    return out.getvalue()


def test_exports_keep_their_comments_and_order(spark, tmp_path, splits):
    head = staff_line(**{h: h for h in HEADER})
    comments = ['said "wait, here", left', "one\ntwo", "plain", 'a\n"b"\n\nc,d', None]
    body = "".join(staff_line(Comments=c or "") for c in comments)
    path = write(tmp_path / "v1", "1.csv", head + body)
    write(tmp_path / "v1", "2.csv", head + body)
    log = read_activity_log(spark, path, "staff_v1").orderBy("activity_id").collect()
    assert [r["comments"] for r in log] == comments * 2
    assert {(r["session_id"], r["active_sec"], r["what"]) for r in log} == {(9, 300, "Care")}
    other = read_activity_log(spark, path, "staff_v1", export=1)
    ids = [r["activity_id"] for r in other.select("activity_id").collect()] + [r["activity_id"] for r in log]
    assert len(set(ids)) == 20 and min(ids[:10]) > max(ids[10:])


def test_torn_records_fail_or_are_reported(spark, tmp_path, splits):
    head = staff_line(**{h: h for h in HEADER})
    good, torn = staff_line(Comments="fine"), staff_line(Comments="cut").replace("cut", '"cut')
    path = write(tmp_path / "t", "1.csv", head + good + "1,2,3\r\n" + good + torn + good)
    with pytest.raises(ValueError, match="never closed"):
        read_activity_log(spark, path, "staff_v1")
    log = read_activity_log(spark, path, "staff_v1", bad="column").orderBy("activity_id").collect()
    assert [r["comments"] for r in log] == ["fine", None, "fine", None, None]
    assert [r["bad_record"] is None for r in log] == [True, False, True, False, False]
    assert log[1]["bad_record"] == "1,2,3" and '"cut' in log[3]["bad_record"]
    path = write(tmp_path / "u", "1.csv", head + good + "1,2,3\r\n")
    with pytest.raises(PySparkException, match="not as many fields"):
        read_activity_log(spark, path, "staff_v1").collect()
    with pytest.raises(PySparkException):  # no column of the bad row is asked for
        read_activity_log(spark, path, "staff_v1").count()


def test_values_that_do_not_parse_are_reported(spark, tmp_path):
    head = staff_line(**{h: h for h in HEADER})
    path = write(tmp_path / "v", "1.csv", head + staff_line(**{"active 1": "soon"}) + staff_line())
    log = read_activity_log(spark, path, "staff_v1", bad="column").orderBy("activity_id").collect()
    assert [r["active_sec"] for r in log] == [None, 300]
    assert "soon" in log[0]["bad_record"] and log[1]["bad_record"] is None
    assert log[0]["what"] == "Care"


def test_an_endless_record_is_bounded(spark, tmp_path):
    """Two stray quotes far apart: their lines come back one by one."""
    text = 'a,b\n1,2\n"3,4\n' + "5,6\n" * 50 + '7",8\n9,10\n'
    path = write(tmp_path / "e", "1.csv", text)
    records = read_records(spark, path, torn="keep", max_lines=20)
    got = parse(records, ["a"], ["line"]).orderBy("line").collect()
    assert [r["bad"] for r in got] == [False] + [True] * 52 + [False]
    one = parse(read_records(spark, path, max_lines=60), ["a"], ["line"]).orderBy("line").collect()
    assert [r["line"] for r in one] == [1, 2, 54] and one[1]["a"].startswith("3,4\n5,6")


def test_no_shuffle_of_lines_without_breaks(spark, tmp_path):
    path = write(tmp_path / "p", "1.csv", "a,b\n1,2\n")
    plan = parse(read_records(spark, path), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 4 and "collect_list" not in plan
    assert read_records(spark, write(tmp_path / "none", "1.csv", "")) is None
