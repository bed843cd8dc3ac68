"""Filter audit against a brute force that applies every order to every row."""

import itertools
import re

import duckdb
import pytest

from shiftlog.llm import filter_audit

SPLIT = re.compile("[^\x20\x09-\x0D]+")


def varied(n=60):
    """Texts that fail every set of the five filters, copies, null and empty
    ones, null ids and languages, repeated rows."""
    bodies = [None, "", " \n", "A B C D", "#", "x" * 200_000]
    for long, rich, capital, sign in itertools.product((0, 1), repeat=4):
        words = [f"w{i}" if rich else "same" for i in range(120 if long else 40)]
        bodies.append(" ".join(w.upper() if capital else w for w in words) + " $" * sign)
    rows = [(i, bodies[i * 7 % len(bodies)], ["en", "de", None, ""][i % 4], "x") for i in range(n)]
    return rows + [rows[1], rows[1], (None, bodies[8], "en", "x"), (None, bodies[8], "en", "x"),
                   (None, "alone", None, "x")]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 50)] + [(1, 1, 1), (None, 1, 1), (7, None, None)]


def brute(rows, labels):
    by_text = {}
    for i, text, *_ in rows:
        if i is not None:
            by_text[text or ""] = min(i, by_text.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, lang, *_ in rows:
        text = text or ""
        words = SPLIT.findall(text)
        fails = {f for f, hit in {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search("[#$%&*|]", text), "E": i is not None and i > by_text[text]}.items() if hit}
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        own = []
        for order in itertools.permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[0]]
                late = sum(f in d[0] for d in gone)
                left = [d for d in left if f not in d[0]]
                gone = gone + now
                removed_by[f] += len(now)
                own.append([part, "".join(order), step, len(left), len(now), late,
                            sum(d[0] == {f} for d in docs), sum(d[1] for d in now),
                            sum(d[2] for d in now), f])
        out += [tuple([*r[:-1], removed_by[r[-1]]]) for r in own]
    return sorted(out)


def tables(spark, rows, labels=LABELS):
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string")
            .repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_audit_matches_brute_force(spark):
    got = filter_audit.audit_documents(*tables(spark, varied()))
    assert sorted(map(tuple, got.collect())) == brute(varied(), LABELS)


def test_sql_matches_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, digest VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", varied())
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert sorted(con.execute(filter_audit.audit_sql()).fetchall()) == brute(varied(), LABELS)


def test_empty_tables(spark):
    none = tables(spark, [], [])
    assert filter_audit.audit_documents(*none).collect() == []
    docs, _ = tables(spark, varied(4))
    assert sorted(map(tuple, filter_audit.audit_documents(docs, none[1]).collect())) \
        == brute(varied(4), [])


@pytest.mark.parametrize("weights", [[], ["bytes"]])
def test_any_filters_and_weights(spark, weights):
    """Three filters, null flags, one integer weight and extra columns."""
    rows = [("p", bool(i & 1), None if i & 2 else True, bool(i & 4), i, "x") for i in range(8)]
    df = spark.createDataFrame(rows, "shard string, a boolean, b boolean, c boolean, bytes int, n string")
    got = filter_audit.audit(df, "shard", ["a", "b", "c"], weights)
    assert got.count() == 18
    first = got.where("filter_order = 'abc' AND step = 2").first()
    hit = [i for i in range(8) if not i & 1 and not i & 2]  # b runs after a
    assert first["removed"] == len(hit)
    assert first["redundant"] == len([i for i in range(8) if i & 1 and not i & 2])
    assert first["unique_fails"] == len([i for i in hit if not i & 4])
    if weights:
        assert first["bytes_lost"] == sum(hit)


def test_removal_steps_are_min_plus():
    names, at = filter_audit.positions("AB")
    assert names == [("A", "B"), ("B", "A")]
    import numpy as np
    fails = np.array([[False, False], [True, False], [False, True], [True, True]])
    assert filter_audit.removal_steps(fails, at).tolist() == [
        [np.inf, np.inf], [1, 2], [2, 1], [1, 1]]


def test_digest_is_of_the_whole_text(spark):
    """Texts that differ in their last character are no copies."""
    a = "word " * 50_000
    docs, labels = tables(spark, [(1, a + "x", "en", ""), (2, a + "y", "en", "")])
    assert filter_audit.failures(docs, labels).where("E").count() == 0
