"""Repair of conversation structure by a secondary-sorted stream.

Rows are shuffled once, by conversation. Inside a partition Spark numbers equal (role, text) of
a conversation, which finds duplicates, and sorts by turn; ``mapInPandas`` then carries the state
of a dynamic program from row to row and from Arrow batch to Arrow batch.

A row's first fault counts: blank (no character but white space), duplicate (role and text seen
earlier), truncated (its last such character isn't one of ``.!?``). Edits make the initials of the
roles match ``(s?(ua)+)?``: Keep (cost 0), Rerole to user or assistant (3), Delete (4; blank and
duplicate rows have to go), Insert an empty user or assistant turn (3); a truncated row that stays
costs 3 more. The cheapest edits are taken, among equals those whose initials come first in ASCII.

The program has four states, by the last role of the output (none, s, u, a). It keeps their
costs less the smallest one and the order of their edit strings, of which there are a few hundred
combinations, so a step is a lookup. It writes four bytes a row: where each state came from. These,
and the texts, are spooled: in memory while small, in the task's scratch file beyond ``SPOOL``
bytes, which goes with the task. At a conversation's end the path is read back in blocks. So a
task's memory doesn't grow with a conversation; as its repaired text has one hash, one task
reads it in order.

Rows of one turn are taken in order of role and text. Null turns come first and don't count
for gaps; a null role or text is one space; a null id is a conversation of its own; an empty role
can't be kept. Repeated rows are duplicates. Rows that are not ``present`` only make their
conversation appear: one without any other row gives zeros, an empty audit and the hash of the
empty string. An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a conversation's texts, and of its backpointers, that stay in memory.
SPOOL = 8 << 20
BLANK = " \t\n\x0b\x0c\r"
EDITS = "DIKR"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: States by the last role of the output, and the state after one more turn of the alternation.
NONE, S, U, A = range(4)
NEXT = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
#: What a row may be: kept or reroled, or only deleted.
FREE, GONE, TRUNCATED = range(3)
BLOCK = 1 << 16


@lru_cache(maxsize=None)
def step(state: tuple, initial: str, kind: int) -> tuple[tuple, int, bytes]:
    """(cost, rank) of the four states after a row, what to add to all costs, and the backpointers.

    A candidate is some state's edits, up to two insertions and one edit of the row. Strings of
    different states that have consumed the same rows are never prefixes of each other, since
    each ends with a row's edit; so their order is by rank, then by what is appended.
    """
    best: dict[int, tuple] = {}
    for g, known in enumerate(state):
        if known is None:
            continue
        cost, rank = known
        at = g
        for k in range(3):
            choices = [("D", at, DELETE)]
            if kind != GONE:
                more = CUT_OFF if kind == TRUNCATED else 0
                choices.append(("R", NEXT[at], REROLE + more))
                if initial == "s" and at == NONE:
                    choices.append(("K", S, KEEP + more))
                if initial in ("u", "a") and NEXT[at] == (U if initial == "u" else A):
                    choices.append(("K", NEXT[at], KEEP + more))
            for edit, to, price in choices:
                one = (cost + k * INSERT + price, rank, "I" * k + edit, g)
                best[to] = min(best.get(to, one), one)
            at = NEXT[at]
    low = min(b[0] for b in best.values())
    order = sorted(best, key=lambda t: best[t][1:3])
    new = tuple((best[t][0] - low, order.index(t)) if t in best else None for t in range(4))
    back = bytes(best[t][3] << 4 | (len(best[t][2]) - 1) << 2 | EDITS.index(best[t][2][-1]) if t in best else 0 for t in range(4))
    return new, low, back


@lru_cache(maxsize=None)
def finish(state: tuple) -> tuple[int, int, int]:
    """(last state, insertions at the end, their and its cost) of the best accepted output."""
    ends = []
    for g, known in enumerate(state):
        at = g
        for k in range(3 if known is not None else 0):
            if at == A or (at == NONE and not k):
                ends.append((known[0] + k * INSERT, known[1], k, g))
            at = NEXT[at]
    cost, _, k, g = min(ends)
    return g, k, cost


class Conversation:
    """One conversation's rows, in order."""

    def __init__(self, conv: str | None):
        self.conv = conv
        self.state: tuple = ((0, 0), None, None, None)
        self.rows = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.before = None
        self.texts, self.back = tempfile.SpooledTemporaryFile(max_size=SPOOL), tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def add(self, turn: str | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turn = turn
            self.turns += 1
            self.high = int(turn)
            self.low = self.high if self.low is None else self.low
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        kind, inside = FREE, text.rstrip(BLANK)
        if not inside:
            self.blank, kind = self.blank + 1, GONE
        elif again:
            self.duplicate, kind = self.duplicate + 1, GONE
        elif inside[-1] not in ".!?":
            self.truncated, kind = self.truncated + 1, TRUNCATED
        self.state, more, back = step(self.state, initial if initial in ("s", "u", "a") else "", kind)
        self.cost += more
        self.rows += 1
        self.back.write(back)
        r, t = (b"", b"") if kind == GONE else (role.encode(), text.encode())
        n = b"" if turn is None else turn.encode()
        self.texts.write(struct.pack("<IIQ", len(n), len(r), len(t)) + n + r + t)

    def path(self) -> Iterator[int]:
        """Each row's insertions (from the third bit on) and edit; reads the backpointers from the end and spools what it finds."""
        state, self.tail, more = finish(self.state)
        self.cost += more
        with tempfile.SpooledTemporaryFile(max_size=SPOOL) as found:
            for lo in range((self.rows - 1) // BLOCK * BLOCK, -1, -BLOCK):
                self.back.seek(4 * lo)
                block = self.back.read(4 * min(BLOCK, self.rows - lo))
                out = bytearray(len(block) // 4)
                for i in range(len(out) - 1, -1, -1):
                    b = block[4 * i + state]
                    out[i] = b & 15
                    state = b >> 4
                found.seek(lo)
                found.write(out)
            found.seek(0)
            while block := found.read(BLOCK):
                yield from block

    def repaired(self) -> Iterator[tuple[str, str | None, str, str]]:
        """(edit, turn, role, text) in order; deleted rows have an empty role and text."""
        state = NONE
        self.texts.seek(0)
        for code in self.path():
            for _ in range(code >> 2):
                state = NEXT[state]
                yield "I", None, ROLE[state], ""
            sizes = struct.unpack("<IIQ", self.texts.read(16))
            turn, role, text = (self.texts.read(n).decode() for n in sizes)
            edit = EDITS[code & 3]
            if edit == "D":
                yield edit, turn or None, "", ""
                continue
            state = S if edit == "K" and role[:1] == "s" else NEXT[state]
            yield edit, turn or None, ROLE[state] if edit == "R" else role, text
        for _ in range(self.tail):
            state = NEXT[state]
            yield "I", None, ROLE[state], ""

    def close(self) -> None:
        self.texts.close()
        self.back.close()

    def summary(self) -> tuple:
        """Counts, the audit and the hash of the repaired rows, written one below the other."""
        done, audit, first = hashlib.sha256(), [], True
        for edit, _, role, text in self.repaired():
            audit.append(edit)
            if edit != "D":
                done.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        self.close()
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(audit), done.hexdigest()


SUMMARY = "_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "_conv string, seq long, edit string, turn string, role string, text string"


def conversations(frames: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Whole conversations of a partition's stream, which runs from batch to batch."""
    now = None
    for frame in frames:
        for conv, turn, role, text, present, again in zip(*(frame[c].tolist() for c in ("_conv", "_turn", "_role", "_text", "_present", "_again")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now
                now = Conversation(conv)
            if present:
                now.add(turn, role, text, again)
    if now is not None:
        yield now


def _frames(rows: Iterator[tuple], names: str, most: int, weight: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows in frames of so many, or of so many characters of one column."""
    columns = [c.split()[0] for c in names.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 if weight is None else 1 + len(row[weight]) // 1000
        if size >= most:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    yield pd.DataFrame(held, columns=columns)


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _frames((c.summary() for c in conversations(frames)), SUMMARY, 10_000, 7)


def _turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for c in conversations(frames):
            for seq, (edit, turn, role, text) in enumerate(c.repaired()):
                yield c.conv, seq, edit, turn, role, text
            c.close()

    return _frames(rows(), TURNS, 10_000, 5)


def sorted_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Rows dealt by conversation, with ``_again`` for a (role, text) seen earlier, in order of turn."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    blank_if_null = lambda c: F.when(there, F.coalesce(F.col(c), F.lit(" ")))
    slim = rows.select(F.col(conv).alias("_c"), F.col(turn).cast("long").alias("_t"), blank_if_null(role).alias("_role"), blank_if_null(text).alias("_text"), there.alias("_present"))
    same = Window.partitionBy("_c", "_present", "_role", "_text").orderBy(F.col("_t").asc_nulls_first())
    seen = slim.repartition("_c").withColumn("_again", F.row_number().over(same) > 1)
    ordered = seen.sortWithinPartitions("_c", F.col("_t").asc_nulls_first(), "_role", "_text", "_again")
    # As text, ids and turns keep their nulls and all their digits in pandas.
    return ordered.select(F.col("_c").cast("string").alias("_conv"), F.col("_t").cast("string").alias("_turn"), "_role", "_text", "_present", "_again")


def summarise(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and initials of the cheapest edits, the hash of the repaired rows."""
    out = sorted_turns(rows, conv, turn, role, text, present).mapInPandas(_summaries, SUMMARY)
    return out.select(F.col("_conv").cast(rows.select(conv).schema[0].dataType).alias(conv), *[c.split()[0] for c in SUMMARY.split(", ")[1:]])


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The edits of every conversation in order: conversation, seq, edit, turn, role, text; rows whose edit isn't D are the repaired conversation."""
    out = sorted_turns(rows, conv, turn, role, text, present).mapInPandas(_turns, TURNS)
    return out.select(F.col("_conv").cast(rows.select(conv).schema[0].dataType).alias(conv), "seq", "edit", F.col("turn").cast("long").alias("turn"), "role", "text")


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by a hash of (conversation, turn); dropped rows stay, not ``present``, so that their conversation isn't lost."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", whole("conv_id"), whole("turn"))) % 20
    role = F.when(h == 4, F.lit("user")).otherwise(whole("role"))
    text = F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(whole("text"), "[.!?]", "")).otherwise(whole("text"))
    copies = F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h != 0).alias("present"), F.explode(copies).alias("_copy")).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return summarise(rows, present=F.col("present"))
