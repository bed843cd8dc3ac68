"""Least-cost repair of role sequences by generalised LR parsing.

The grammar's LR(0) automaton is built from its productions.  Parsing goes over
a conversation's rows; the stacks that some sequence of edits can lead to are
kept side by side and equal ones are merged, leaving the cheapest edits, ties
by the ASCII-least audit.  A left-recursive grammar of turns has few stacks
(six for the default one), so what a row does to all of them is a small table,
and what many rows do together is one too: ``compose`` joins such tables, which
lets a conversation be parsed in segments.

Audits are never compared as strings.  All edits of a row but inserts end in a
letter other than ``I``, so of two audits over the same rows neither begins the
other unless they are equal; their order after a row follows from their order
before it, and a rank per stack is enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MAX_STACKS = 64
#: A stack that cannot be reached.
NONE = (1 << 60, 0)

Stack = tuple[int, ...]
#: cost, letters of the edits, initials of the inserted roles, and the initial
#: the row itself ends up with (None: deleted).
Move = tuple[int, str, str, "str | None"]


@dataclass(frozen=True)
class Grammar:
    """``rules`` are (left, right) with one-letter symbols; terminals are role
    initials.  The empty conversation is legal beside what ``start`` derives.
    Rows may be given, and turns inserted with, the roles ``free``."""
    rules: tuple[tuple[str, str], ...] = (("D", "ua"), ("D", "sua"), ("D", "Dua"))
    start: str = "D"
    free: str = "ua"

    @cached_property
    def _states(self) -> tuple[list[frozenset], dict[tuple[int, str], int]]:
        """LR(0) item sets, an item being (rule, dot), and their transitions."""
        def closed(items: set) -> frozenset:
            todo = list(items)
            while todo:
                rule, dot = todo.pop()
                after = self.rules[rule][1][dot:dot + 1]
                new = {(i, 0) for i, (left, _) in enumerate(self.rules) if left == after} - items
                items |= new
                todo += new
            return frozenset(items)

        states = [closed({(i, 0) for i, (left, _) in enumerate(self.rules) if left == self.start})]
        edges = {}
        for at, items in enumerate(states):  # grows while it is walked
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = closed({(r, d + 1) for r, d in items if self.rules[r][1][d:d + 1] == symbol})
                if to not in states:
                    states.append(to)
                edges[at, symbol] = states.index(to)
        for items in states:
            if len(items) > 1 and any(d == len(self.rules[r][1]) for r, d in items):
                raise ValueError(f"not an LR(0) grammar: {self.rules}")
        return states, edges

    def shift(self, stack: Stack, terminal: str) -> Stack | None:
        """The stack after a terminal and all reductions it allows."""
        states, edges = self._states
        to = edges.get((stack[-1], terminal))
        if to is None:
            return None
        stack = (*stack, to)
        while len(done := states[stack[-1]]) == 1:
            ((rule, dot),) = done
            left, right = self.rules[rule]
            if dot < len(right):
                break
            stack = stack[:len(stack) - len(right)]
            goto = edges.get((stack[-1], left))
            if goto is None:
                return None
            stack = (*stack, goto)
        return stack

    def legal(self, stack: Stack) -> bool:
        return stack in ((0,), (0, self._states[1].get((0, self.start))))

    @cached_property
    def stacks(self) -> list[Stack]:
        """Every stack that some sequence of roles leads to."""
        terminals = sorted({s for _, right in self.rules for s in right}
                           - {left for left, _ in self.rules})
        found = [(0,)]
        for stack in found:
            for t in terminals:
                to = self.shift(stack, t)
                if to and to not in found:
                    found.append(to)
            if len(found) > MAX_STACKS:
                raise ValueError(f"over {MAX_STACKS} stacks: {self.rules}")
        return found

    @cached_property
    def _inserts(self) -> list[dict[int, str]]:
        """Per stack, the stacks that inserts alone lead to, with their roles."""
        out = []
        for stack in self.stacks:
            reach, edge = {stack: ""}, [stack]
            while edge:
                new = {}
                for s in edge:
                    for role in self.free:
                        to = self.shift(s, role)
                        if to and to not in reach:
                            new[to] = min(new.get(to, "~"), reach[s] + role)
                reach |= new
                edge = list(new)
            out.append({self.stacks.index(s): roles for s, roles in reach.items()})
        return out

    @cached_property
    def endings(self) -> list[str | None]:
        """Per stack, the roles to insert to make it a legal end."""
        out = []
        for reach in self._inserts:
            ends = [r for to, r in reach.items() if self.legal(self.stacks[to])]
            out.append(min(ends, key=lambda r: (len(r), r), default=None))
        return out

    def moves(self, initial: str, truncated: bool) -> list[dict[int, Move]]:
        """Per stack, the cheapest way to each stack over one row that may be
        kept: inserts, then the row's own edit."""
        key = (initial, truncated)
        if key not in self._moves:
            own = TRUNCATED * truncated
            edits = [(KEEP + own, "K", initial), (DELETE, "D", None),
                     *((REROLE + own, "R", role) for role in self.free)]
            table = []
            for reach in self._inserts:
                best: dict[int, Move] = {}
                for via, roles in reach.items():
                    for cost, letter, role in edits:
                        stack = self.stacks[via]
                        to = stack if role is None else self.shift(stack, role)
                        if to is None:
                            continue
                        to = self.stacks.index(to)
                        move = (cost + INSERT * len(roles), "I" * len(roles) + letter, roles, role)
                        if to not in best or move[:2] < best[to][:2]:
                            best[to] = move
                table.append(best)
            self._moves[key] = table
        return self._moves[key]

    @cached_property
    def _moves(self) -> dict:
        return {}


#: A row to parse: role initial, whether truncated, how many rows that must be
#: deleted follow it; an initial of None stands for such rows alone.
Row = tuple["str | None", bool, int]


def advance(grammar: Grammar, rows: Sequence[Row], entry: int, trace: list | None = None):
    """(cost, rank) per stack after ``rows``, from one stack; ``trace`` gets
    per row the stack that each stack came from."""
    now = [NONE] * len(grammar.stacks)
    now[entry] = (0, 0)
    base = 0  # deletions that no choice avoids
    for initial, truncated, more in rows:
        base += DELETE * more
        if initial is None:
            if trace is not None:
                trace.append(None)
            continue
        best: dict[int, tuple] = {}
        for at, (cost, rank) in enumerate(now):
            if cost >= NONE[0]:
                continue
            for to, move in grammar.moves(initial, truncated)[at].items():
                new = (cost + move[0], rank, move[1], at)
                if to not in best or new < best[to]:
                    best[to] = new
        ranks = {k: i for i, k in enumerate(sorted({b[1:3] for b in best.values()}))}
        now = [(best[i][0], ranks[best[i][1:3]]) if i in best else NONE for i in range(len(now))]
        if trace is not None:
            trace.append({to: b[3] for to, b in best.items()})
    return [(c + base, r) if c < NONE[0] else NONE for c, r in now]


def table(grammar: Grammar, rows: Sequence[Row]) -> list[list[tuple[int, int]]]:
    """What ``rows`` do from every stack."""
    return [advance(grammar, rows, entry) for entry in range(len(grammar.stacks))]


def compose(before: Sequence[tuple[int, int]], then: Sequence[Sequence[tuple[int, int]]]):
    """(cost, rank) per stack after a further segment, and the stack that each
    came through."""
    best: dict[int, tuple] = {}
    for via, (cost, rank) in enumerate(before):
        if cost >= NONE[0]:
            continue
        for to, (more, own) in enumerate(then[via]):
            if more < NONE[0]:
                new = (cost + more, rank, own, via)
                if to not in best or new < best[to]:
                    best[to] = new
    ranks = {k: i for i, k in enumerate(sorted({b[1:3] for b in best.values()}))}
    after = [(best[i][0], ranks[best[i][1:3]]) if i in best else NONE for i in range(len(then))]
    return after, {to: b[3] for to, b in best.items()}


def best_end(grammar: Grammar, vector: Sequence[tuple[int, int]]) -> tuple[int, int, str]:
    """Total cost, last stack and the roles inserted after the last row."""
    cost, _, at = min((c + INSERT * len(grammar.endings[i]), r, i)
                      for i, (c, r) in enumerate(vector)
                      if c < NONE[0] and grammar.endings[i] is not None)
    return cost, at, grammar.endings[at]


def edits(grammar: Grammar, rows: Sequence[Row], entry: int, leave: int) -> Iterator[Move]:
    """The move of each row on the cheapest way between two stacks (rows that
    must be deleted alone: none of the letters but theirs)."""
    trace: list = []
    advance(grammar, rows, entry, trace)
    at, back = leave, []
    for (initial, truncated, more), came in zip(reversed(rows), reversed(trace)):
        if came is None:
            back.append((0, "D" * more, "", None))
            continue
        via = came[at]
        cost, letters, roles, role = grammar.moves(initial, truncated)[via][at]
        back.append((cost, letters + "D" * more, roles, role))
        at = via
    return reversed(back)
