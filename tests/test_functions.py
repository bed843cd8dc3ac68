from pyspark.sql import functions as F

from shiftlog.functions.aggregates import agg_mean, agg_sum, mean_table, n_distinct
from shiftlog.functions.labels import fold_flags, label_roles
from shiftlog.functions.rounding import pct_label, round_columns, round_to
from shiftlog.functions.timefmt import (hms_to_seconds, seconds_to_hms, time_slot,
                                        trailing_number)


def test_hms_parse_past_midnight_and_bad_text(spark):
    df = spark.createDataFrame([("24:36:20",), ("07:05:09",), (" 1:02:03 ",), ("bad",),
                                ("12:61:00",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(hms_to_seconds("t")).collect()]
    assert got == [88580, 25509, 3723, None, None, None, None]


def test_seconds_to_hms_round_trip(spark):
    df = spark.createDataFrame([(88580,), (0,), (59,), (360000,), (None,), (-61,)], "s long")
    got = [r[0] for r in df.select(seconds_to_hms("s")).collect()]
    assert got == ["24:36:20", "00:00:00", "00:00:59", "100:00:00", None, "-00:01:01"]


def test_time_slot_boundaries(spark):
    hours = [0, 6, 7, 11, 12, 16, 17, 20, 21, 23, None]
    df = spark.createDataFrame([(None if h is None else h * 3600 + 59,) for h in hours], "s long")
    got = [r[0] for r in df.select(time_slot("s")).collect()]
    assert got == ["other", "other", "morning", "morning", "afternoon", "afternoon",
                   "evening", "evening", "other", "other", "other"]


def test_trailing_number_no_match_is_null(spark):
    df = spark.createDataFrame([("10175_10260_60",), ("x",), ("1_2_",), (None,), ("5_007",)],
                               "t string")
    assert [r[0] for r in df.select(trailing_number("t")).collect()] == [60, None, None, None, 7]


def test_rounding_rules(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.05,), (0.125,), (1.005,), (None,)], "x double")
    got = df.select(round_to("x", 0).alias("r0"), round_to("x", 1).alias("r1"),
                    round_to("x", 2).alias("r2")).collect()
    assert [r.r0 for r in got] == [2.0, 4.0, 0.0, 0.0, 1.0, None]      # half-even at 0
    assert [r.r1 for r in got] == [2.5, 3.5, 0.1, 0.1, 1.0, None]      # half-up on 6-place value
    assert [r.r2 for r in got] == [2.5, 3.5, 0.05, 0.13, 1.01, None]


def test_round_columns_by_suffix(spark):
    df = spark.createDataFrame([(1.234, 5.678)], "a_min double, b double")
    assert round_columns(df).first() == (1.23, 5.678)


def test_pct_label_prints_like_r(spark):
    df = spark.createDataFrame([(2.0,), (12.5,), (100.0,), (2.7,)], "p double")
    got = [r[0] for r in df.select(pct_label("p", 2.7)).collect()]
    assert got == ["", "12.5%", "100%", ""]


def test_na_propagating_and_skipping_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)],
                               "k string, x double")
    got = {r.k: r for r in df.groupBy("k").agg(
        agg_sum("x").alias("s"), agg_sum("x", na="skip").alias("ss"),
        agg_mean("x").alias("m"), agg_mean("x", na="skip").alias("ms")).collect()}
    assert got["a"].s is None and got["a"].ss == 1.0 and got["a"].m is None
    assert got["b"].s == 6.0 and got["b"].m == 3.0
    assert got["c"].ss == 0.0 and got["c"].ms is None    # R: sum(NA, na.rm=TRUE) == 0


def test_n_distinct_counts_null_once_and_table_mean_drops_it(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "s long")
    r = df.agg(n_distinct("s").alias("n"), mean_table("s").alias("m")).first()
    assert r.n == 3 and r.m == 1.5


FLAGS = [("a", "Doctor"), ("b", "Nurse"), ("c", "Other")]


def test_fold_flags_modes(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (0, 0, 0, 0), (None, 1, None, 1),
                                (1, 1, 1, 1), (None, None, None, None)],
                               "a int, b int, c int, n int")
    got = df.select(fold_flags(FLAGS).alias("script"),
                    fold_flags(FLAGS, empty="No one").alias("nb"),
                    fold_flags(FLAGS, empty="", tail=("n", "No one")).alias("patient")).collect()
    assert [r.script for r in got] == ["Doctor, Other", None, "Nurse", "Doctor, Nurse, Other", None]
    assert [r.nb for r in got] == ["Doctor, Other", "No one", "Nurse", "Doctor, Nurse, Other",
                                   "No one"]
    assert [r.patient for r in got] == ["Doctor, Other", "", "Nurse, No one",
                                        "Doctor, Nurse, Other, No one", ""]


def test_label_roles_hospital_and_polyclinic(spark):
    df = spark.createDataFrame([("Nurse",), ("Clerk",), (None,)], "r string")
    m = {"Nurse": "- Nurses"}
    got = df.select(label_roles(F.col("r"), m).alias("h"),
                    label_roles(F.col("r"), m, prefix_others="- ").alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [("- Nurses", "- Nurses"), ("Clerk", "- Clerk"),
                                         (None, "- NA")]
