"""Conversation structure repair: cheapest edits by a rank-compressed dynamic programme over macro edits.

A macro edit is a run of inserts and the edit of one turn, such as ``K``, ``ID`` or ``IIR``. These words are a prefix-free
code, so audit strings of as many turns compare as the sequences of their macros do, by the order of the codes. A layer
therefore keeps, for each state of the role grammar, a cost and the *rank* of its best audit string in place of the string;
pointers to the parents give the strings back at the end.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Fixed values of the task: costs of the edits, and what a truncated row costs that stays.
RETURN, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant; the latter and the first may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an inserted or reroled turn has in a state.
REPLY = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: A longer run of inserts comes back to a state that a shorter one reaches.
RUNS = range(3)
CODES = {code: at for at, code in enumerate(sorted("I" * run + edit for run in RUNS for edit in "DKR"))}
#: Inserts after the last turn, by state.
CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}
#: Any state's further course can be had from any other for at most two inserts and the deletion of a system turn more.
SLACK = 2 * INSERT + DELETE
DAMAGES = 20
BLANK = " \t\n\x0b\x0c\r"
#: Characters of a text by which turns that tie are ordered; then its digest decides.
HEAD = 64
ROWS = "conv_id long, place int, turn long, role string, head string, key string, n long, fault string, text string"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, at long, edit string, role string, text string"


def macros(state: int, kind: str) -> Iterator[tuple[str, int, int]]:
    """(code, cost, next state) of all macro edits of a row. ``kind``: ``D`` must go; else the role's initial, with ``t`` if truncated."""
    late = TRUNCATED * kind.endswith("t")
    for run in RUNS:
        yield "I" * run + "D", INSERT * run + DELETE, state
        if kind != "D":
            if (state, kind[0]) in NEXT:
                yield "I" * run + "K", INSERT * run + late, NEXT[state, kind[0]]
            yield "I" * run + "R", INSERT * run + RETURN + late, NEXT[state, REPLY[state][0]]
        state = NEXT[state, REPLY[state][0]]


class Layers:
    """All layers that occur, each with its successors. Costs are held relative to the layer's least, and states that lie
    over SLACK above it can't be on a cheapest way, so there are few layers however long conversations are."""

    def __init__(self) -> None:
        self.steps: list[tuple] = []
        self.memo: dict[tuple, int] = {}

    def step(self, layer: tuple, kind: str) -> int:
        """Number of the step from a layer ((cost, rank) or None a state): (added cost, next layer, parents, codes)."""
        at = self.memo.get((layer, kind))
        if at is None:
            best: list = [None] * 4
            for state, held in enumerate(layer):
                for code, cost, after in macros(state, kind) if held else ():
                    found = (held[0] + cost, held[1], CODES[code], state, code)
                    if best[after] is None or found < best[after]:
                        best[after] = found
            least = min(b[0] for b in best if b)
            best = [b if b and b[0] <= least + SLACK else None for b in best]
            ranks = {key: rank for rank, key in enumerate(sorted({b[1:3] for b in best if b}))}
            new = tuple((b[0] - least, ranks[b[1:3]]) if b else None for b in best)
            self.steps.append((least, new, [b and b[3] for b in best], [b and b[4] for b in best]))
            at = self.memo[layer, kind] = len(self.steps) - 1
        return at


class Course:
    """One conversation's layers: four bytes a row."""

    START = ((0, 0), None, None, None)

    def __init__(self, layers: Layers) -> None:
        self.layers, self.layer, self.cost, self.trail = layers, self.START, 0, array("I")

    def push(self, kind: str, times: int = 1) -> None:
        for _ in range(times):
            at = self.layers.step(self.layer, kind)
            added, self.layer = self.layers.steps[at][:2]
            self.cost += added
            self.trail.append(at)

    def finish(self) -> tuple[int, str]:
        """Least cost, and its least audit string."""
        cost, _, state = min((h[0] + INSERT * CLOSING[s], h[1], s) for s, h in enumerate(self.layer) if h)
        codes = ["I" * CLOSING[state]]
        for at in reversed(self.trail):
            _, _, parents, chosen = self.layers.steps[at]
            codes.append(chosen[state])
            state = parents[state]
        return self.cost + cost, "".join(reversed(codes))


class Conversation:
    """Takes a conversation's rows without texts, then with them, each in order."""

    def __init__(self, conv_id: int | None, layers: Layers) -> None:
        self.conv_id, self.course = conv_id, Course(layers)
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last, self.turns, self.distinct = 0, None, None, 0
        self.audit, self.cost, self.at, self.state, self.hash, self.first = None, 0, 0, 0, hashlib.sha256(), True

    def row(self, turn: int | None, role: str, n: int, fault: str | None) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.last = initial
        if turn is not None and (self.turns is None or self.turns[1] != turn):
            self.turns = (self.turns[0] if self.turns else turn, turn)
            self.distinct += 1
        if fault in ("blank", "duplicate"):
            self.faults[fault] += n
            self.course.push("D", n)
            return
        self.faults["duplicate"] += n - 1
        self.faults["truncated"] += fault == "truncated"
        self.course.push(initial + ("t" if fault == "truncated" else ""))
        self.course.push("D", n - 1)

    def edit(self, letter: str, role: str, text: str) -> tuple:
        """One edit; what stays goes into the digest."""
        if letter in "IR":
            role = REPLY[self.state]
        if letter != "D":
            self.state = NEXT[self.state, role[0]]
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False
        self.at += 1
        return self.conv_id, self.at - 1, letter, role, text

    def closed(self) -> None:
        if self.audit is None:
            self.cost, self.audit = self.course.finish()

    def text(self, role: str, text: str, n: int) -> Iterator[tuple]:
        self.closed()
        for _ in range(n):
            while self.audit[self.at] == "I":
                yield self.edit("I", "", "")
            yield self.edit(self.audit[self.at], role, text)

    def rest(self) -> Iterator[tuple]:
        self.closed()
        while self.at < len(self.audit):
            yield self.edit("I", "", "")

    def summary(self) -> tuple:
        gaps = min(self.turns[1] - self.turns[0] + 1 - self.distinct, 2**63 - 1) if self.turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, self.audit, self.hash.hexdigest())


def damage(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` damaged by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out
    of it, 3 repeats the row, 4 sets role user. Nulls are read as one space, but for conv_id and turn, which stay."""
    space = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % DAMAGES
    t = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _streamed(turns: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Rows by conversation: one to open it, then its rows without texts, equal ones as one with their number and first
    fault, then those with texts. Each in order of turn, role, head and key."""
    space = F.lit(" ")
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.length("role"), F.lit(":"), "role", "text")
    t = t.select("*", F.substring("text", 1, HEAD).alias("head"), F.sha2(said, 256).alias("key"))
    shown = F.rtrim("text", F.lit(BLANK))
    own = F.when(shown == "", "blank").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = stored(t.groupBy("conv_id", "turn", "role", "head", "key", own.alias("own")).agg(F.count("*").alias("n")), "turns", keep=True)
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = stored(rows.groupBy("key").agg(F.min(place).alias("first")), "first-turns", keep=True)
    rows = rows.join(first, "key").withColumn("fault", F.when(F.col("own") == "blank", "blank").when(place > F.col("first"), "duplicate").otherwise(F.col("own")))

    def shaped(df: DataFrame, **columns: F.Column) -> DataFrame:
        fields = [f.split() for f in ROWS.split(", ")]
        return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])

    ids = t.select("conv_id") if conversations is None else t.select("conv_id").unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv_id")))
    own = {c: F.col(c) for c in ("conv_id", "turn", "role", "head", "key")}
    every = (shaped(ids.distinct(), conv_id=F.col("conv_id"), place=F.lit(0))
             .unionByName(shaped(rows, **own, place=F.lit(1), n=F.col("n"), fault=F.col("fault")))
             .unionByName(shaped(t, **own, place=F.lit(2), n=F.lit(1), text=F.col("text"))))
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "place", "turn", "role", "head", "key").select("conv_id", "place", "turn", "role", "n", "fault", "text")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(False, edited turn) and, at the end of each conversation, (True, its summary)."""
    layers, now = Layers(), None
    for part in slices(batches):
        for conv_id, place, turn, role, n, fault, text in zip(*(c.to_pylist() for c in part.columns)):
            if place == 0:
                if now:
                    yield from ((False, e) for e in now.rest())
                    yield True, now.summary()
                now = Conversation(conv_id, layers)
            elif place == 1:
                now.row(turn, role, n, fault)
            else:
                yield from ((False, e) for e in now.text(role, text, n))
    if now:
        yield from ((False, e) for e in now.rest())
        yield True, now.summary()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits of all conversations: (conv_id, at, edit, role, text), one row an edit in order.

    Edits are K(eep), R(erole), D(elete) and I(nsert), see ``summaries``. A deleted row has its own role and text; the
    others, in order, are the repaired conversation.
    """
    schema = _arrow(TURNS)
    return _streamed(turns, None).mapInArrow(lambda batches: _batches((row for end, row in _walk(batches) if not end), schema), TURNS)


def summaries(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, faults by kind, illegal neighbours, and the cost, audit string and digest of its repair.

    Rows go by turn (nulls first), role, the first 64 characters of the text and then its digest; equal rows stay side by
    side. A null role or text is one space, which is blank. A null conv_id is a conversation. Those of ``conversations``
    (conv_id) come too if they have no rows: zeros, an empty audit, the digest of nothing. Other columns are ignored; an
    empty table gives no rows. Gaps end at 2**63 - 1.

    Faults are found by joins on digests, so a text that is said over and over is split like any hot key. Equal rows are
    counted before they are dealt out. What one conversation needs in one place is what the result itself asks for: its
    audit string (a letter a row, beside four bytes a row) and one digest over its texts, which pass in order, none held.
    """
    schema = _arrow(SUMMARY)
    return _streamed(turns, conversations).mapInArrow(lambda batches: _batches((row for end, row in _walk(batches) if end), schema), SUMMARY)
