"""Best-fit packing of token sequences by a plan over the length histogram.

Documents are tokenised once; long ones are cut into pieces.  Best-fit
decreasing then runs over the histogram of piece lengths (at most
``capacity`` counts, whatever the number of documents) and yields planned
slots; each piece takes the slot of its rank within its length.  Ranks need
no sort: a piece has its rank within its task and length, and the counts per
(length, task) give the tasks' offsets.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlog.llm.bpe import encoder, read_file
from shiftlog.llm.common import int_lists, rows_of, stored, text_of

CAPACITY = 1024
#: Pre-token pattern of a byte-level tokenizer file (its own default).
BYTE_LEVEL = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_PIECES = "doc_id long, piece int, start long, length int, task long, rank long"
#: Ids travel as bytes (little-endian, 32 bits each): one value a piece.
_PACKED, _IDS, _DIGEST = "ids binary", "input_ids array<int>", "ids_digest long"


@dataclass(frozen=True)
class Slots:
    """Planned slots of ``n`` equal pieces: rank ``first_rank + i`` of
    ``length`` goes to sequence ``first_sequence + i // stack`` at
    ``offset + (i % stack) * length``."""

    length: int
    first_rank: int
    n: int
    first_sequence: int
    offset: int
    stack: int


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best-fit decreasing over counts: the sequences and offsets that placing
    the pieces one by one, longest first, each in the fullest sequence that
    still takes it, would give.

    Sequences with equal room are one group; a step fills whole groups, so the
    work and the plan depend on the capacity, not on the counts.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, n)
    keys: list[int] = []
    plan, next_sequence = [], 0

    def give(r: int, first: int, n: int) -> None:
        if n and r:
            if r not in room:
                room[r] = []
                bisect.insort(keys, r)
            room[r].append((first, n))

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(keys, length)
            if at < len(keys):
                r = keys[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], keys[at]
            else:
                r, first = capacity, next_sequence
                n = -(-left // (capacity // length))
                next_sequence += n
            stack = r // length
            take = min(left, n * stack)
            full, more = divmod(take, stack)
            plan.append(Slots(length, rank, take, first, capacity - r, stack))
            give(r - stack * length, first, full)
            give(r - more * length, first + full, 1 if more else 0)
            rest = full + (1 if more else 0)
            give(r, first + rest, n - rest)
            left, rank = left - take, rank + take
    return plan


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
                    digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """One row per piece with its ids (or their ``digest``, taken of their
    little-endian 32-bit form) and its rank within task and length.

    A document is its ids then ``end_id``; one longer than ``capacity`` is cut
    into pieces of ``capacity``, the first one taking the remainder.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer_path))
    last_kind = _DIGEST if digest else _PACKED

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value, BYTE_LEVEL)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], "<u4").tobytes()

        def flush(rows):
            cols = list(zip(*rows))
            last = pa.array(cols[5], pa.int64() if digest else pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()),
                 pa.array([task] * len(rows), pa.int64()), pa.array(cols[4], pa.int64()), last],
                names=["doc_id", "piece", "start", "length", "task", "rank", last_kind.split()[0]])

        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(*rows_of(batch, "doc_id", "text")):
                coded = enc.encode(text) + end
                total = len(coded) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - 1) % capacity + 1 if piece == 0 else capacity
                    own = coded[4 * start:4 * (start + length)]
                    rows.append((doc, piece, start, length, seen[length],
                                 digest(own) if digest else own))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
                held += total
                if held >= 1_000_000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, f"{_PIECES}, {last_kind}")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY,
         digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length,
    input_ids, sequence_id, offset.

    With ``digest`` the ids do not leave the tasks that make them: instead of
    ``input_ids`` there is ``ids_digest`` (long), for those who want the places
    alone.

    Null text is the empty text (one piece, the end id); a null or repeated
    doc_id is packed like any other row; an empty table gives no rows; other
    columns are ignored.  Equal lengths are ranked in scan order.
    """
    last_kind = _DIGEST if digest else _IDS
    last = last_kind.split()[0]
    pieces = stored(tokenise_pieces(docs, tokenizer_path, end_id, capacity, digest), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task",
                              F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most one count per length up to the capacity
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(plan_best_fit(counts, capacity), key=lambda s: (s.length, s.first_rank))
    ranked = (pieces.join(offsets, ["length", "task"])
              .select("doc_id", "piece", "start", "length",
                      (F.col("before") + F.col("rank")).alias("rank"), "ids_digest" if digest else "ids"))
    # the plan's size follows the capacity, so every task can hold it
    slots = np.array([[s.length, s.first_rank, s.first_sequence, s.offset, s.stack] for s in plan],
                     np.int64).reshape(-1, 5)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.searchsorted(slots[:, 0], np.arange(capacity + 2)), None
        hi = lo[1:]
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(4).to_numpy()
            at = np.empty(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                at[own] = lo[k] + np.searchsorted(slots[lo[k]:hi[k], 1], rank[own], "right") - 1
            s, i = slots[at], rank - slots[at, 1]
            held = batch.column(5)
            if not digest:
                held = int_lists(np.frombuffer(b"".join(held.to_pylist()), "<i4"),
                                 np.concatenate([[0], length.cumsum()]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(length), held,
                 pa.array(s[:, 2] + i // s[:, 4]), pa.array(s[:, 3] + i % s[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", last, "sequence_id", "offset"])

    return ranked.mapInArrow(take, f"doc_id long, piece int, start long, length long, {last_kind}, "
                                   "sequence_id long, offset long")
