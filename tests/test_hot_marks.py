"""Hot keys of a salted join: what their marks take through the driver, and what they match."""

import pytest
from pyspark.sql import functions as F

from shiftlog.operators import joins
from shiftlog.operators.joins import SALT, add_salt, attach_role, hot_keys
from test_plans_and_oracle import _children


def _broadcast_rows(node):
    """Rows of every broadcast of a plan that ran."""
    own = [node.metrics().apply("numOutputRows").value()] \
        if node.getClass().getSimpleName() == "BroadcastExchangeExec" else []
    return own + [n for c in _children(node) for n in _broadcast_rows(c)]


@pytest.fixture
def log(spark):
    """5,000 keys of six rows (hot), 1,000 of one row, 300 rows without a key."""
    key = F.when(F.col("id") < 30_000, F.col("id") % 5_000).when(F.col("id") < 31_000, F.col("id"))
    return spark.range(31_300).select(key.alias("session_id"), F.col("id").alias("activity_id"))


def test_broadcast_does_not_grow_with_hot_keys(spark, log, monkeypatch):
    monkeypatch.setattr(joins, "MARK_WORDS", 16, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        salted = add_salt(log, hot_keys(log, ["session_id"], hot_rows=5), ["session_id"])
        got = salted.collect()
        rows = _broadcast_rows(salted._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == 1 and rows[0] <= 16                      # before: a row for every hot key
    assert len(got) == 31_300
    assert all(r[SALT] > 0 for r in got if r["session_id"] is None or r["session_id"] < 5_000)


def test_cold_keys_stay_unsalted(log):
    salted = add_salt(log, hot_keys(log, ["session_id"], hot_rows=5), ["session_id"])
    assert salted.where(F.col("session_id") >= 30_000).where(F.col(SALT) > 0).count() < 50


@pytest.mark.parametrize("words", [1, joins.__dict__.get("MARK_WORDS", 1)])
@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_shared_bits_and_other_types_lose_no_match(spark, log, monkeypatch, words, null_safe, kind):
    """Every key shares its bit with others when there is one word."""
    monkeypatch.setattr(joins, "MARK_WORDS", words, raising=False)
    lk = spark.range(0, 40_000, 3).select(F.col("id").cast(kind).alias("session_id"),
                                          F.concat(F.lit("r"), "id").alias("role")) \
        .unionByName(spark.sql(f"select cast(null as {kind}) as session_id, 'none' as role"))
    hot = hot_keys(log, ["session_id"], hot_rows=5)
    salted = attach_role(add_salt(log, hot, ["session_id"]), lk, hot=hot, null_safe=null_safe)
    plain = attach_role(log, lk, null_safe=null_safe)
    cols = ["session_id", "activity_id", "role"]
    assert sorted(map(tuple, salted.select(*cols).collect()), key=str) == \
        sorted(map(tuple, plain.select(*cols).collect()), key=str)


def test_text_keys_match_numbers_as_the_join_compares_them(spark):
    log = spark.range(60).select(F.lit("007").alias("session_id"), F.col("id").alias("activity_id"))
    lk = spark.createDataFrame([(7, "Nurse"), (8, "Clerk")], "session_id bigint, role string")
    hot = hot_keys(log, ["session_id"], hot_rows=5)
    out = attach_role(add_salt(log, hot, ["session_id"]), lk, hot=hot)
    assert [r["role"] for r in out.collect()] == ["Nurse"] * 60
