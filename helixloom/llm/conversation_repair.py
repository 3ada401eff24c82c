"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by streaming.

Rows are repartitioned by conversation and sorted by turn; a task then reads them in Arrow batches and carries, from row
to row and batch to batch, one state for each place in the grammar `(s?(ua)+)?` (nothing yet, after a system row, after a
user row, after an assistant row): the least cost to get there, the running hash of the repaired rows, and the order of
the edits so far among those of the other states. Texts are let go as they pass. What each state came from is a byte for
each row and state; blocks of BLOCK_ROWS rows of these backpointers are spilled as rows of the output, so a giant conversation
holds no more than one block. The blocks are sorted within their partition from last to first (Spark's sort spills to disk),
and a second stream walks back through them to spell out the edits. Nothing is shuffled twice: the repeated rows of a
conversation are also told by a window that uses the same partitioning. A conversation is one task's work, as its hash
runs through its rows in order; memory does not follow its length but for the audit, which is part of the result.

Of edits of equal cost the least string of initials (Delete, Insert, Keep, Rerole) is taken. All survivors end with the
edit of the same row and none is the beginning of another, so their order can be carried along as a rank.

Defined results: a null role or text is one space, and so is a null id or turn in the damage key; a null id is one
conversation of its own; null turns come first and count for no gap; rows of the same turn are ordered by role and text;
repeated rows are duplicates; a conversation without rows after damage has zeros, an empty audit and the hash of the
empty string; very long texts are hashed as they stream; an empty table gives an empty result; other columns are not
carried, so their names do not matter. Roles count by their first letter, as written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, put_back, set_aside

BLOCK_ROWS = 4096
STATES = range(4)  # nothing yet, after a system row, after a user row, after an assistant row
ACCEPTING = (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}
EDITS = "DKR"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
MOST_INSERTS = 2  # from any place in the grammar, two inserted rows reach any other that an insert can reach
#: A row's first fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def wanted(state: int) -> str:
    """The role that an inserted or reroled row takes here."""
    return "a" if state == 2 else "u"


def _advanced(state: int, inserts: int) -> tuple[int, list[str]]:
    roles = []
    for _ in range(inserts):
        roles.append(wanted(state))
        state = NEXT[state, roles[-1]]
    return state, roles


@lru_cache(maxsize=None)
def steps(initial: str, fault: int) -> list[list[tuple[int, int, int, int, list[str], str]]]:
    """For each state after a row, the ways there: (cost, state before, order of the edits, backpointer, roles inserted,
    new role or "" to keep it; None where the row goes)."""
    order = {e: k for k, e in enumerate(sorted("I" * n + e for n in range(MOST_INSERTS + 1) for e in EDITS))}
    out: list[list] = [[] for _ in STATES]
    for state in STATES:
        for n in range(MOST_INSERTS + 1):
            at, inserted = _advanced(state, n)
            ways = [("D", at, DELETE, None)]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED if fault == CUT else 0
                if (at, initial) in NEXT:
                    ways.append(("K", NEXT[at, initial], extra, ""))
                ways.append(("R", NEXT[at, wanted(at)], REROLE + extra, NAMES[wanted(at)]))
            for edit, to, cost, role in ways:
                out[to].append((cost + n * INSERT, state, order["I" * n + edit], state | n << 2 | EDITS.index(edit) << 4, inserted, role))
    return out


class Repair:
    """What is carried of one conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.block, self.back = conv, 0, bytearray()
        self.states: list = [(0, 0, hashlib.sha256(), False), None, None, None]  # cost, rank, hash, whether it has a row
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = None
        self.initial = None

    def add(self, turn: str | None, role: str, text: str, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self._step(role, text, steps(initial if initial in ("s", "u", "a") else "", fault))

    def _step(self, role: str, text: str, ways: list) -> None:
        before, chosen = self.states, []
        for to in STATES:
            best = None
            for cost, state, order, back, inserted, new in ways[to]:
                if before[state] is not None:
                    key = (before[state][0] + cost, before[state][1], order)
                    if best is None or key < best[0]:
                        best = (key, state, back, inserted, new)
            chosen.append(best)
            self.back.append(best[2] if best else 0)
        ranks = {k: n for n, k in enumerate(sorted(c[0][1:] for c in chosen if c))}
        self.states = [c and self._state(c, ranks, before, role, text) for c in chosen]

    @staticmethod
    def _state(chosen: tuple, ranks: dict, before: list, role: str, text: str) -> tuple:
        key, state, _, inserted, new = chosen
        _, _, digest, some = before[state]
        rows = [f"{NAMES[r]}:" for r in inserted]
        if new is not None:
            rows.append(f"{new or role}:{text}")
        if rows:
            digest = digest.copy()
            digest.update(("\n" * some + "\n".join(rows)).encode("utf-8", "surrogatepass"))
        return key[0], ranks[key[1:]], digest, some or bool(rows)

    def spilled(self, last: bool) -> tuple:
        """A block of backpointers; the last one comes with the result."""
        row = (self.conv, self.block, bytes(self.back), *(self._result() if last else (None,) * 9))
        self.block, self.back = self.block + 1, bytearray()
        return row

    def _result(self) -> tuple:
        ends = []
        for state in STATES:
            for n in range(MOST_INSERTS + 1):
                at, inserted = _advanced(state, n)
                if at in ACCEPTING and self.states[state] is not None:
                    cost, rank, _, _ = self.states[state]
                    ends.append((cost + n * INSERT, rank, n, state, inserted))
        cost, _, n, state, inserted = min(ends)
        _, _, digest, some = self.states[state]
        if inserted:
            digest = digest.copy()
            digest.update(("\n" * some + "\n".join(f"{NAMES[r]}:" for r in inserted)).encode())
        gaps = int(self.last_turn) - int(self.first_turn) + 1 - self.turns if self.turns else 0
        return state | n << 2, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, digest.hexdigest(), self.block


FORWARD = ["conv", "block", "back", "final", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "repaired_sha256", "blocks"]
FORWARD_SCHEMA = "conv string, block int, back binary, final int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string, blocks int"
RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT_SCHEMA = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of conversations and turns to blocks of backpointers."""
    now: Repair | None = None
    for b in batches:
        out = []
        for conv, alive, turn, role, text, fault in zip(b["conv"], b["alive"], b["turn"], b["role"], b["text"], b["fault"]):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.spilled(last=True))
                now = Repair(conv)
            if alive:
                now.add(turn, role, text, fault)
                if len(now.back) >= len(STATES) * BLOCK_ROWS:
                    out.append(now.spilled(last=False))
        yield pd.DataFrame(out, columns=FORWARD).astype({c: "Int64" for c in FORWARD if c not in ("conv", "back", "repaired_sha256")})
    if now is not None:
        yield pd.DataFrame([now.spilled(last=True)], columns=FORWARD)


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks, each conversation's last one first, to results: backpointers are followed to the first row."""
    audit, result, state = bytearray(), None, 0
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if r.final is not None and not pd.isna(r.final):
                state = int(r.final) & 3
                audit = bytearray(b"I" * (int(r.final) >> 2))
                result = [getattr(r, c) for c in RESULT if c != "audit"]
            for k in range(len(r.back) - len(STATES), -1, -len(STATES)):
                back = r.back[k + state]
                audit += EDITS[back >> 4].encode() + b"I" * (back >> 2 & 3)
                state = back & 3
            if r.block == 0:
                out.append([*result[:-1], audit[::-1].decode(), result[-1]])
        yield pd.DataFrame(out, columns=RESULT)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df with the damage of the drill: by crc32 of `conv:turn` modulo 20, a row is dropped (0), emptied (1), loses its ends
    of sentences (2), is repeated (3), or is given to the user (4). Dropped rows stay, emptied, with `_c_alive` false."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn))) % 20
    hurt = F.when(harm <= 1, F.lit("")).when(harm == 2, F.translate(spaced(text), ".!?", "")).otherwise(spaced(text))
    marked = df.withColumns({"_c_alive": harm != 0, text: hurt, role: F.when(harm == 4, F.lit("user")).otherwise(spaced(role))})
    return marked.withColumn("_c_copy", F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_c_copy")


def first_fault(role: Column, text: Column, earlier: Column) -> Column:
    """The first fault of a row; `earlier` tells that its role and text were there before."""
    end = F.rtrim(text, F.lit(WS_CHARS))
    return F.when(end == "", BLANK).when(earlier, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation of df. Rows
    where the column `alive` is false only make their conversation known."""
    kind = dict(df.dtypes)[conv]
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    living = F.coalesce(F.col(f"`{alive}`"), F.lit(False)) if alive else F.lit(True)
    rows = df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("n"), living.alias("alive"), spaced(role).alias("role"), spaced(text).alias("text")).repartition("c")
    seen = F.row_number().over(Window.partitionBy("c", "alive", "role", "text").orderBy(F.asc_nulls_first("n"))) > 1
    judged = rows.withColumn("fault", first_fault(F.col("role"), F.col("text"), seen).cast("int"))
    stream = judged.sortWithinPartitions(F.asc_nulls_first("c"), F.asc_nulls_first("n"), "role", "text")
    blocks = stream.select(F.col("c").cast("string").alias("conv"), "alive", F.col("n").cast("string").alias("turn"), "role", "text", "fault").mapInPandas(_forward, FORWARD_SCHEMA)
    found = blocks.sortWithinPartitions("conv", F.desc("block")).mapInPandas(_backward, RESULT_SCHEMA)
    return found.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)


def drill(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations damaged, then repaired."""
    df, named = set_aside(df.select(*[F.col(f"`{c}`") for c in (conv, turn, role, text)]), "_c_")
    hurt = damaged(df, *(named[c] for c in (conv, turn, role, text)))
    return put_back(repair(hurt, *(named[c] for c in (conv, turn, role, text)), alive="_c_alive"), named)
