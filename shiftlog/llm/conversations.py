"""Conversation structure repair over a table of turns.

Equal rows are counted together first, then all rows are range-partitioned and
sorted by conversation and turn, so that a conversation of any length is cut
into segments of bounded size that many tasks hold.  Conversations that lie in
one segment are repaired there.  Of the others every segment gives a small
table (what its rows do to each parser stack, see ``role_grammar``); these are
composed per conversation, which fixes the stacks each segment begins and ends
with, and the segments are then repaired apart.

Order of rows: turn (null first); rows of one turn by the first 32 characters
of role and text and then by a hash of both, equal rows beside each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlog.llm import role_grammar as lr
from shiftlog.llm.common import batch_of, stored, text_of

#: Bounds of a segment: different rows, and bytes of text (one row may be longer).
SEGMENT_ROWS = 8192
SEGMENT_BYTES = 4 << 20
ROLES = {"u": "user", "a": "assistant"}
GRAMMAR = lr.Grammar()

_BLANKS = "\t\n\v\f\r "
_ROWS = "array<struct<turn:bigint,role:string,text:string,n:bigint>>"
_ROWS_ARROW = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()),
                                  ("text", pa.string()), ("n", pa.int64())]))
_STATS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by crc32 of ``conv_id:turn`` modulo 20
    (0: dropped, 1: text emptied, 2: its ``.!?`` removed, 3: repeated, 4: role
    ``user``).  Nulls are one space, in the key as well; ``n`` says how often a
    row stands (0: dropped, the conversation stays known)."""
    def known(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = (F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", ""))
            .otherwise(known("text")))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"),
                       text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, whole, rows): the rows of each conversation in
    order, cut into segments that ``part`` and ``chunk`` number over all;
    ``whole`` where one segment surely holds them all.  Null roles and texts are empty.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    counted = (rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                           text_of("role").alias("role"), text_of().alias("text"), "n")
               .groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")))
    order = ["conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32),
             F.xxhash64("role", "text")]
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    schema = pa.schema([("conv_id", _arrow(rows, "conv_id")), ("part", pa.int32()),
                        ("chunk", pa.int32()), ("whole", pa.bool_()), ("rows", _ROWS_ARROW)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made, count, size = [], 0, 0  # segments to emit
        held, held_bytes = [], 0  # rows of the segment that is being filled
        conv, chunk, begin = None, 0, 0  # ``begin``: the conversation's first chunk

        def close(whole: bool) -> None:
            nonlocal held, held_bytes, count, size, chunk
            made.append((conv, part, chunk, whole, held))
            count, size = count + 1, size + held_bytes
            held, held_bytes, chunk = [], 0, chunk + 1

        started, first = False, True
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c, row in zip(ids, zip(*(batch.column(i).to_pylist() for i in range(1, 5)))):
                if not started:
                    conv, started = c, True
                elif c != conv:
                    close(whole=chunk == begin and not first)
                    conv, begin, first = c, chunk, False
                elif len(held) >= SEGMENT_ROWS or held_bytes >= SEGMENT_BYTES:
                    close(whole=False)
                if row[3]:
                    held.append(dict(zip(("turn", "role", "text", "n"), row)))
                    held_bytes += len(row[2]) + len(row[1]) + 32
                if size >= SEGMENT_BYTES or count >= 1024:
                    yield batch_of(made, schema)
                    made, count, size = [], 0, 0
        if started:
            close(whole=False)  # it may go on in the next partition
        yield batch_of(made, schema)

    out = ranged.mapInArrow(cut, f"conv_id {kind}, part int, chunk int, whole boolean, rows {_ROWS}")
    return stored(out, "segments")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)


# -- one segment --------------------------------------------------------------


def _digest(conv, row: dict) -> bytes:
    """Of a row within its conversation, for finding it again elsewhere."""
    out = hashlib.blake2b(digest_size=16)
    for part in (repr(conv), row["role"], row["text"]):
        data = part.encode()
        out.update(len(data).to_bytes(8, "big") + data)
    return out.digest()


def measure(rows: list[dict], seen_before: set[bytes], conv=None) -> tuple[list[lr.Row], dict]:
    """The segment's rows as the parser takes them, and its figures."""
    seen = set()
    parsed, count = [], dict.fromkeys(_STATS, 0)
    first = last = low = high = None
    for row in rows:
        role, text, n = row["role"], row["text"], row["n"]
        ink = text.rstrip(_BLANKS)
        again = (role, text) in seen or (bool(seen_before) and _digest(conv, row) in seen_before)
        seen.add((role, text))
        short = not again and ink != "" and ink[-1] not in ".!?"
        if ink == "":
            count["blank"] += n
        else:
            count["duplicate"] += n - 1 + again
            count["truncated"] += short
        gone = ink == "" or again
        parsed.append((None, False, n) if gone else (role[:1], short, n - 1))
        initial = role[:1]
        count["illegal"] += n - 1 + (count["n"] > 0 and not _legal_pair(last, initial))
        count["n"] += n
        if first is None:
            first = initial
        last = initial
        turn = row["turn"]
        if turn is not None:
            count["turns"] += turn != high
            low, high = turn if low is None else low, turn
    return parsed, count | {"first": first, "last": last, "low": low, "high": high}


def _legal_pair(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def joined(a: dict, b: dict) -> dict:
    """Figures of two segments that follow one another."""
    if not b["n"]:
        return a
    if not a["n"]:
        return b
    out = {k: a[k] + b[k] for k in _STATS}
    out["illegal"] += not _legal_pair(a["last"], b["first"])
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"],
                  "low": b["low"] if a["low"] is None else a["low"],
                  "high": a["high"] if b["high"] is None else b["high"]}


def _summary(count: dict, cost: int) -> tuple:
    gaps = 0 if count["low"] is None else count["high"] - count["low"] + 1 - count["turns"]
    return (gaps, *(count[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost)


def repaired(rows: list[dict], parsed: list[lr.Row], entry: int, leave: int,
             tail: str) -> tuple[str, list[tuple[str, str]]]:
    """Audit and turns (role, text) of a segment between two stacks, with the
    roles inserted after it."""
    audit, turns = [], []
    for row, (_, letters, inserted, role) in zip(rows, lr.edits(GRAMMAR, parsed, entry, leave)):
        audit.append(letters)
        turns += [(ROLES[r], "") for r in inserted]
        if role is not None:
            kept = letters[len(inserted)] == "K"
            turns.append((row["role"] if kept else ROLES[role], row["text"]))
    return "".join(audit) + "I" * len(tail), turns + [(ROLES[r], "") for r in tail]


# -- whole conversations ------------------------------------------------------

_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECES = ("part int, chunk int, whole boolean, last boolean, audit string, "
           "turns array<struct<role:string,text:string>>, "
           + ", ".join(f"{f} long" for f in _FIGURES))
_PIECES_ARROW = [("part", pa.int32()), ("chunk", pa.int32()), ("whole", pa.bool_()),
                 ("last", pa.bool_()), ("audit", pa.string()),
                 ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                 *((f, pa.int64()) for f in _FIGURES)]


def repair(rows: DataFrame) -> DataFrame:
    """Pieces of the repaired conversations.

    ``rows``: conv_id, turn, role, text and n (how often the row stands; 0: not
    at all, though its conversation is returned); further columns are ignored.
    The cheapest edits (keep 0, rerole to user or assistant 3, delete 4, insert
    an empty turn 3, a truncated row that stays 3 more; blank and repeated rows
    must be deleted) make the role initials follow the grammar; ties go to the
    ASCII-least audit.

    Returned per segment: conv_id, ``part`` and ``chunk`` (its place in the
    conversation), ``whole`` (it is the only one), ``last``, ``audit`` (initials
    of its edits), ``turns`` (role, text) and, in the last, the conversation's
    gaps, blank, duplicate, truncated, illegal and cost.  Conversations without
    rows give one empty piece, an empty table none; a null conv_id is a
    conversation of its own.
    """
    pieces = segments(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow(rows, "conv_id")), *_PIECES_ARROW])
    ddl = f"conv_id {kind}, {_PIECES}"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, held in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                parsed, count = measure(held, set())
                cost, leave, tail = lr.best_end(GRAMMAR, lr.advance(GRAMMAR, parsed, 0))
                audit, turns = repaired(held, parsed, 0, leave, tail)
                out.append((conv, 0, 0, True, True, audit,
                            [{"role": r, "text": t} for r, t in turns], *_summary(count, cost)))
            yield batch_of(out, schema)

    done = pieces.where("whole").select("conv_id", "rows").mapInArrow(alone, ddl)
    return done.unionByName(_repair_open(pieces.where("NOT whole"), ddl, schema))


def _repair_open(pieces: DataFrame, ddl: str, schema: pa.Schema) -> DataFrame:
    """As ``repair``, of the conversations that may have several segments."""
    size = len(GRAMMAR.stacks)
    conv_kind = pieces.schema["conv_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("digest", pa.binary()), ("part", pa.int32()), ("chunk", pa.int32())])
        for batch in batches:
            for conv, part, chunk, held in zip(*(c.to_pylist() for c in batch.columns)):
                found = {_digest(conv, r) for r in held}
                yield batch_of([(d, part, chunk) for d in found], kinds)

    # a row seen in an earlier segment of its conversation
    found = stored(pieces.select("conv_id", "part", "chunk", "rows")
                   .mapInArrow(digests, "digest binary, part int, chunk int"), "digests")
    first = (found.groupBy("digest").agg(F.min(F.struct("part", "chunk")).alias("first"),
                                         F.count(F.lit(1)).alias("times"))
             .where("times > 1").select("digest", "first"))
    seen = (found.join(first, "digest")
            .where(F.struct("part", "chunk") > F.col("first"))
            .groupBy("part", "chunk").agg(F.collect_list("digest").alias("seen")))  # of one segment

    stat_names = [*_STATS, "first", "last", "low", "high"]
    stat_kinds = ["long"] * len(_STATS) + ["string", "string", "long", "long"]
    small = ", ".join(f"{n}_ {k}" for n, k in zip(stat_names, stat_kinds)) + ", costs binary"
    small_arrow = [*((f"{n}_", pa.string() if k == "string" else pa.int64())
                     for n, k in zip(stat_names, stat_kinds)), ("costs", pa.binary())]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([schema.field("conv_id"), ("part", pa.int32()), ("chunk", pa.int32()),
                           ("rows", _ROWS_ARROW), ("seen", pa.list_(pa.binary())), *small_arrow])
        for batch in batches:
            for conv, part, chunk, held, before in zip(*(c.to_pylist() for c in batch.columns)):
                parsed, count = measure(held, set(before or ()), conv)
                costs = np.array(lr.table(GRAMMAR, parsed), np.int64).tobytes()
                yield batch_of([(conv, part, chunk, held, before,
                                 *(count[n] for n in stat_names), costs)], kinds)

    known = stored(pieces.select("conv_id", "part", "chunk", "rows")
                   .join(seen, ["part", "chunk"], "left")
                   .select("conv_id", "part", "chunk", "rows", "seen")
                   .mapInArrow(measured, f"conv_id {conv_kind}, part int, chunk int, rows {_ROWS}, "
                                         f"seen array<binary>, {small}"), "measured")

    figures = ", ".join(f"{f} long" for f in _FIGURES)

    def way(segs: pa.Table) -> pa.Table:
        """Stacks between the segments of one conversation: its rows here are
        some hundred bytes per segment."""
        segs = segs.sort_by([("part", "ascending"), ("chunk", "ascending")])
        rows = segs.to_pylist()
        total, vector, came = None, lr.advance(GRAMMAR, [], 0), []
        for row in rows:
            count = {n: row[f"{n}_"] for n in stat_names}
            total = count if total is None else joined(total, count)
            then = np.frombuffer(row["costs"], np.int64).reshape(size, size, 2).tolist()
            vector, via = lr.compose(vector, [[tuple(x) for x in line] for line in then])
            came.append(via)
        cost, at, tail = lr.best_end(GRAMMAR, vector)
        ends, ins = [], []
        for via in reversed(came):
            ends.append(at)
            at = via[at]
            ins.append(at)
        n = len(rows)
        own = _summary(total, cost)
        return pa.table({
            "part": segs["part"], "chunk": segs["chunk"],
            "entry": pa.array(ins[::-1], pa.int32()), "leave": pa.array(ends[::-1], pa.int32()),
            "tail": pa.array([""] * (n - 1) + [tail]),
            "last": pa.array([False] * (n - 1) + [True]),
            **{f: pa.array([None] * (n - 1) + [v], pa.int64()) for f, v in zip(_FIGURES, own)}})

    ways = (known.drop("rows", "seen").groupBy("conv_id")
            .applyInArrow(way, "part int, chunk int, entry int, leave int, tail string, "
                               f"last boolean, {figures}"))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, chunk, held, before, entry, leave, tail, last, *own in zip(
                    *(c.to_pylist() for c in batch.columns)):
                parsed, _ = measure(held, set(before or ()), conv)
                audit, turns = repaired(held, parsed, entry, leave, tail)
                yield batch_of([(conv, part, chunk, False, last, audit,
                                 [{"role": r, "text": t} for r, t in turns], *own)], schema)

    return (known.select("conv_id", "part", "chunk", "rows", "seen").join(ways, ["part", "chunk"])
            .select("conv_id", "part", "chunk", "rows", "seen", "entry", "leave", "tail", "last",
                    *_FIGURES).mapInArrow(replay, ddl))


def summaries(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s pieces: conv_id, the figures,
    the whole ``audit`` and ``repaired_sha256`` (of ``role:text`` lines).

    A digest of a text can only be taken from its start to its end, so the
    pieces of one conversation pass through one task, in order and one at a
    time; conversations of one piece stay where they are.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow(pieces, "conv_id")), *((f, pa.int64()) for f in _FIGURES),
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    ddl = f"conv_id {kind}, " + ", ".join(f"{f} long" for f in _FIGURES) \
        + ", audit string, repaired_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, state, empty = [], hashlib.sha256(), True
        for batch in batches:
            out = []
            for conv, last, edits, turns, *figures in zip(*(c.to_pylist() for c in batch.columns)):
                audit.append(edits)
                for turn in turns:
                    state.update(("" if empty else "\n").encode())
                    state.update(f"{turn['role']}:{turn['text']}".encode())
                    empty = False
                if last:
                    out.append((conv, *figures, "".join(audit), state.hexdigest()))
                    audit, state, empty = [], hashlib.sha256(), True
            yield batch_of(out, schema)

    used = ["conv_id", "last", "audit", "turns", *_FIGURES]
    ordered = (pieces.where("NOT whole").repartition("conv_id")
               .sortWithinPartitions("conv_id", "part", "chunk"))
    return (pieces.where("whole").select(used).mapInArrow(digest, ddl)
            .unionByName(ordered.select(used).mapInArrow(digest, ddl)))


def repair_sql() -> str:
    """DuckDB SQL of ``summaries(repair(damaged(conversations)))``: the stacks
    as four states, advanced row by row in a recursive query.  Rows of one turn
    whose role and text begin alike follow their text here, not a hash."""
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
      FROM conversations),
-- CRC-32: per byte one exclusive or, then eight shifts (marked -1)
h AS (SELECT *, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''),
              lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                            ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS kind
      FROM k),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                  ELSE text END AS text,
             unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM h),
c AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT c.c, turn, role, text, row_number() OVER (PARTITION BY c.c
             ORDER BY turn NULLS FIRST, left(role, 32), left(text, 32), role, text) AS i
      FROM e JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id),
f AS (SELECT *, left(role, 1) AS r,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?]{blank}*$') THEN 'truncated' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before
      FROM o),
ins AS (SELECT * FROM (VALUES ('E','E',0), ('E','U',1), ('E','A',2), ('S','S',0), ('S','U',1),
        ('S','A',2), ('U','U',0), ('U','A',1), ('A','A',0), ('A','U',1)) v(s, via, n)),
sh AS (SELECT * FROM (VALUES ('E','s','S'), ('E','u','U'), ('S','u','U'), ('U','a','A'),
       ('A','u','U')) v(via, r, t)),
m AS (SELECT s, t, r, repeat('I', n) || 'K' AS letters, 3 * n AS cost, 'K' AS edit FROM ins JOIN sh USING (via)
      UNION ALL SELECT s, t, r, repeat('I', n) || 'R', 3 * n + 3, 'R' FROM ins JOIN sh USING (via) WHERE r <> 's'
      UNION ALL SELECT s, via, NULL, repeat('I', n) || 'D', 3 * n + 4, 'D' FROM ins),
dp AS (SELECT c, 0::BIGINT AS i, 'E' AS s, {{'cost': 0::BIGINT, 'audit': ''}} AS b FROM c
       UNION ALL
       SELECT dp.c, dp.i + 1, m.t,
              min({{'cost': b.cost + m.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END,
                    'audit': b.audit || letters}})
       FROM dp JOIN f ON f.c = dp.c AND f.i = dp.i + 1
               JOIN m ON m.s = dp.s AND (edit = 'D' OR (fault NOT IN ('blank', 'duplicate')
                                                        AND (edit = 'R' OR m.r = f.r)))
       GROUP BY dp.c, dp.i, m.t),
n AS (SELECT c.c, c.conv_id, count(i) AS rows, count(DISTINCT turn) AS turns,
             max(turn) - min(turn) + 1 AS span,
             count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
      FROM c LEFT JOIN f ON f.c = c.c GROUP BY c.c, c.conv_id),
z AS (SELECT n.c, min({{'cost': b.cost + CASE s WHEN 'U' THEN 3 WHEN 'S' THEN 6 ELSE 0 END,
                        'audit': b.audit || CASE s WHEN 'U' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END}}) AS b
      FROM n JOIN dp ON dp.c = n.c AND dp.i = n.rows GROUP BY n.c),
l AS (SELECT c, p, substr(audit, p, 1) AS edit FROM
      (SELECT c, b.audit AS audit, unnest(range(1, length(b.audit) + 1)) AS p FROM z)),
q AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place
      FROM l WINDOW w AS (PARTITION BY c ORDER BY p)),
g AS (SELECT q.c, place, edit, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
             max(CASE WHEN place = 1 AND edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY q.c) AS system
      FROM q LEFT JOIN f ON f.c = q.c AND f.i = q.i WHERE edit <> 'D'),
t AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user'
                                ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS text
      FROM g GROUP BY c)
SELECT conv_id, coalesce(span - turns, 0)::BIGINT AS gaps, blank, duplicate, truncated, illegal,
       z.b.cost AS cost, z.b.audit AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM n JOIN z ON z.c = n.c LEFT JOIN t ON t.c = n.c
"""
