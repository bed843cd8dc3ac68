"""Conversation repair against a search over all edits, whole and in segments."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from shiftlog.llm import conversations
from shiftlog.llm import role_grammar as lr

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


def damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def least_edits(rows, faults):
    """Cheapest (cost, audit) by uniform-cost search, no grammar machinery:
    the roles so far decide what may follow."""
    def follows(last, role):  # last: "" nothing, s, u, a
        return role == {"": "u", "s": "u", "u": "a", "a": "u"}[last] or (last == "" and role == "s")

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, turns = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, turns
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in "ua":
            if follows(last, role):
                heapq.heappush(heap, (cost + 3, audit + "I", i, role,
                                      turns + ((conversations.ROLES[role], ""),)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in ("s", "u", "a") and follows(last, role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1],
                                          turns + ((role, text),)))
                for r in "ua":
                    if follows(last, r):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, r,
                                              turns + ((conversations.ROLES[r], text),)))


def brute(rows):
    out = []
    for conv, mine in damage(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in mine:
            ink = text.rstrip("\t\n\v\f\r ")
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen
                          else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, kept = least_edits(mine, faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(n, seed, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
            text = rng.choice(["Yes.", "No!", "cut", "Why? ", " \n", None, "", "é", f"t{rng.randrange(9)}."])
            rows.append((conv if conv else None, rng.choice([turn, turn + 1, None, turn * 3]), role,
                         text, "x"))
    # no two different rows of one turn begin alike, so the order is the brute force's
    return rows


def run(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = conversations.summaries(conversations.repair(conversations.damaged(df)))
    return sorted(map(tuple, got.collect()), key=repr)


def test_repair_matches_search(spark):
    rows = talk(120, 1)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bound", [1, 3])
def test_segments_change_nothing(spark, monkeypatch, bound):
    """One conversation of half of all rows, cut into segments of few rows."""
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", bound)
    rows = talk(20, 2) + [(99, t, r, x, "") for _, t, r, x, _ in talk(1, 3, 150)] \
        + [(99, 500 + i, "user", "again.", "") for i in range(40)] \
        + [(99, None, "user", "same.", "")] * 30
    cut = conversations.segments(conversations.damaged(spark.createDataFrame(rows, SCHEMA)))
    assert cut.where("conv_id = 99").count() > 50 // bound
    assert run(spark, rows) == brute(rows)


def test_sql_matches_search():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, extra VARCHAR)")
    rows = talk(60, 6)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    got = sorted(con.execute(conversations.repair_sql()).fetchall(), key=repr)
    assert got == brute(rows)


def test_every_short_conversation():
    """All kinds of rows in all orders, against the search."""
    kinds = [("s", False), ("u", False), ("a", False), ("x", False), ("u", True), ("a", True),
             (None, False)]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "xray", None: "user"}
    g = conversations.GRAMMAR
    for n in range(5):
        for row in itertools.product(kinds, repeat=n):
            parsed = [(i, t, 1 if i is None else 0) for i, t in row]
            cost, leave, tail = lr.best_end(g, lr.advance(g, parsed, 0))
            audit = "".join(m[1] for m in lr.edits(g, parsed, 0, leave)) + "I" * len(tail)
            faults = ["blank" if i is None else "truncated" if t else "" for i, t in row]
            want = least_edits([(0, names[i], "") for i, _ in row], faults)
            assert (cost, audit) == want[:2], row


def test_composed_tables_equal_one_parse():
    rng = random.Random(4)
    g = conversations.GRAMMAR
    for _ in range(200):
        rows = [(rng.choice(["s", "u", "a", "x", None]), rng.random() < 0.3, rng.randrange(2))
                for _ in range(rng.randrange(1, 14))]
        vector, at = lr.advance(g, [], 0), 0
        while at < len(rows):
            to = at + rng.randrange(0, 4)
            vector, _ = lr.compose(vector, lr.table(g, rows[at:to]))
            at = to
        assert vector == lr.advance(g, rows, 0)


def test_grammar_tables():
    g = lr.Grammar()
    for text in map("".join, itertools.chain.from_iterable(
            itertools.product("sua", repeat=n) for n in range(8))):
        stack = (0,)
        for c in text:
            stack = stack and g.shift(stack, c)
        assert bool(stack and g.legal(stack)) == bool(re.fullmatch("(s?(ua)+)?", text)), text
    with pytest.raises(ValueError):
        lr.Grammar((("D", "u"), ("D", "uD"))).stacks  # shift and reduce meet
    with pytest.raises(ValueError):
        lr.Grammar((("D", "uDa"), ("D", "s"))).stacks  # nested without end


def test_edges(spark):
    assert run(spark, []) == []
    dropped = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "gone.", "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows)[0][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = [(7, None, None, None, None), (None, None, "user", "long " * 300_000 + ".", "x"),
            (8, -(2 ** 40), "user", "far.", ""), (8, 2 ** 40, "assistant", "apart.", "")]
    assert run(spark, rows) == brute(rows)
