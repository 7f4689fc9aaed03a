"""Repair of conversation structure by iterative-deepening A*.

The turns of a conversation are brought, at least cost, into the order of roles
``(s?(ua)+)?`` (initials of the roles: an opening system turn may precede pairs of
user and assistant). The edits, in ASCII order of their initials:

* ``D`` Delete a turn, cost 4; blank and repeated turns must go;
* ``I`` Insert a turn without text, user or assistant, cost 3;
* ``K`` Keep a turn, cost 0;
* ``R`` Rerole a turn to user or assistant, cost 3.

A truncated turn that isn't deleted adds 3. What is wrong with a turn is its first
fault of blank (no character but white space), duplicate (role and text seen earlier
in the conversation) and truncated (last such character none of ``.!?``).

A search state is (turns read, role said last). Depth-first search tries edits in ASCII
order below a bound on cost so far plus an estimate of the rest; the bound rises to the
least value that went beyond it. A table of states that failed, with the least cost so
far, keeps a state from being searched again at the same bound. The estimate never
exceeds the true rest: it is the least cost if a conversation might end after any role,
so the bound rises a few times only and the search is linear in the number of turns.
The first path accepted has the least cost and, of all such, the ASCII-least edits: two
of them can't be prefixes of each other, as inserts cost.

Spark groups the turns; one conversation, as one value of the result, is what a task
holds. Searches depend on initials and faults alone and are remembered per worker.

Defined cases: null roles and texts are one space; turns are ordered by turn (null
first), then role, then text, and repeated rows stay (as duplicates); rows with a null
conv_id form one conversation; a role that starts with another letter, or is empty,
can't be kept; no rows give no rows; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
# Role said last -> initial of the one that must follow, and the state after it.
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}
INK = re.compile(r"[^\x20\x09-\x0D]")
ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
FAULTS = ("blank", "duplicate", "truncated")
OUT = ("conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
       "repaired array<struct<role:string,text:string>>")
HELD = 1 << 16


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """First fault of each turn (role, text), or an empty string."""
    seen: set[tuple[str, str]] = set()
    found = []
    for turn in turns:
        if not INK.search(turn[1]):
            found.append("blank")
        elif turn in seen:
            found.append("duplicate")
        else:
            found.append("" if ENDED.search(turn[1]) else "truncated")
        seen.add(turn)
    return found


def _estimates(initials: tuple[str, ...], found: tuple[str, ...]) -> list[dict[str, int]]:
    """Least cost of the rest, by turns read and role said last, if any role may end."""
    after = {"": 0, "s": 0, "u": 0, "a": 0}
    table = [after]
    for initial, fault in zip(reversed(initials), reversed(found)):
        now = {state: DELETE + rest for state, rest in after.items()}
        if fault in ("", "truncated"):
            extra = CUT if fault else 0
            for state, to in WANTED.items():
                now[state] = min(now[state], extra + after[to] + (0 if initial == to else REROLE))
            if initial == "s":
                now[""] = min(now[""], extra + after["s"])
        # At most one insert in a row can help: two lead back, or past a kept "s".
        after = {state: min(rest, INSERT + now[WANTED[state]]) for state, rest in now.items()}
        table.append(after)
    table.reverse()
    return table


@lru_cache(HELD)
def cheapest(initials: tuple[str, ...], found: tuple[str, ...]) -> tuple[int, str]:
    """(cost, initials of the edits) of the cheapest repair, ASCII-least of all such."""
    rest = _estimates(initials, found)
    length = len(initials)

    def edits(i: int, state: str) -> Iterator[tuple[str, int, int, str]]:
        to = WANTED[state]
        extra = CUT if i < length and found[i] == "truncated" else 0
        if i < length:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, to
        if i < length and found[i] in ("", "truncated"):
            if initials[i] == to:
                yield "K", extra, i + 1, to
            elif initials[i] == "s" and state == "":
                yield "K", extra, i + 1, "s"
            if initials[i] != to:
                yield "R", REROLE + extra, i + 1, to

    bound = rest[0][""]
    while True:
        beyond = None
        failed: dict[tuple[int, str], int] = {}
        path: list[str] = []
        stack = [(0, "", 0, edits(0, ""))]
        while stack:
            i, state, cost, more = stack[-1]
            if i == length and state in ("", "a"):
                return cost, "".join(path)
            for edit, price, to_i, to_state in more:
                so_far = cost + price
                if failed.get((to_i, to_state), so_far + 1) <= so_far:
                    continue
                total = so_far + rest[to_i][to_state]
                if total > bound:
                    beyond = total if beyond is None else min(beyond, total)
                    continue
                path.append(edit)
                stack.append((to_i, to_state, so_far, edits(to_i, to_state)))
                break
            else:
                failed[i, state] = min(cost, failed.get((i, state), cost))
                stack.pop()
                if path:
                    path.pop()
        bound = beyond


def apply_edits(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits. Roles given follow from those before."""
    out: list[tuple[str, str]] = []
    state, at = "", 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        state = turns[at][0][:1] if edit == "K" else WANTED[state]
        if edit == "K":
            out.append(turns[at])
        else:
            out.append((ROLES[state], "" if edit == "I" else turns[at][1]))
        at += edit != "I"
    return out


def _repaired(turns: list[dict]) -> tuple:
    """Columns of one conversation after its id."""
    numbers = {t["turn"] for t in turns if t["turn"] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    said = [(t["role"], t["text"]) for t in turns]
    found = faults(said)
    initials = tuple(role[:1] for role, _ in said)
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(initials, tuple(found))
    fixed = [{"role": r, "text": t} for r, t in apply_edits(said, audit)]
    return (gaps, *(found.count(f) for f in FAULTS), illegal, cost, audit, fixed)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired"]
    for batch in batches:
        rows = [_repaired(turns) for turns in batch.column(1).to_pylist()]
        columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps (turn
    numbers missing between the first and the last), blank, duplicate, truncated (turns of
    that fault), illegal (adjacent roles out of order), cost, audit (initials of the edits)
    and repaired (array of role, text)."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    own = own_columns(rows, "conv_id", "turn", "role", "text")
    turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").cast("long").alias("turn"), said("role"), said("text")))).alias("turns"))
    return turns.mapInArrow(_repair, OUT.format(own.schema["conv_id"].dataType.simpleString()))
