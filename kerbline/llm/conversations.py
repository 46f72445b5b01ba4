"""Conversation repair: the cheapest edits that make the turns of a conversation alternate, found by a Viterbi search that emits what all survivors share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.common import SPACE, spread

#: States of the pattern (s?(ua)+)?, by what was given last: nothing, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: From a state with a kept row of this initial, or with a row given this role, to a state.
MOVES = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {"u": "user", "a": "assistant"}
#: What following any continuation of the first state from the second costs more, at most: an insert where user or assistant is missing, a delete where a system row cannot stand.
DETOUR = {(NONE, SYSTEM): 2 * INSERT, (NONE, USER): INSERT + DELETE, (NONE, ASSISTANT): DELETE, (SYSTEM, NONE): 0, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 0,
          (USER, NONE): INSERT, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT, (ASSISTANT, NONE): 0, (ASSISTANT, SYSTEM): 2 * INSERT, (ASSISTANT, USER): INSERT}
LEGAL = {"su", "ua", "au"}
LONGEST = (1 << 63) - 1


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it
    a user's. Null roles and texts, and null parts of the key, are one space; a null turn stays null."""
    kind, role, text = F.col("_kind"), F.col("role"), F.col("text")

    def spaced(name: str) -> Column:
        return F.coalesce(rows[f"`{name}`"].cast("string"), F.lit(" "))

    work = rows.select(rows[f"`{conv_col}`"].alias("conv_id"), rows[f"`{turn_col}`"].cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"),
                       (F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20).alias("_kind")).where("_kind <> 0")
    work = work.withColumn("role", F.when(kind == 4, F.lit("user")).otherwise(role))
    work = work.withColumn("text", F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text))
    return work.withColumn("_copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


class Step:
    """An edit in the tree of survivors: refs counts the steps and survivors that rest on it."""

    __slots__ = ("parent", "edit", "row", "depth", "refs")

    def __init__(self, parent: Step | None, edit: str, row: tuple[str, str] | None):
        self.parent, self.edit, self.row, self.refs = parent, edit, row, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def before(a: tuple[Step, str], b: tuple[Step, str]) -> bool:
    """Whether one sequence of edits is less than another: both are read back, to where they part, in full."""
    (x, last_x), (y, last_y) = a, b
    left, right = [last_x], [last_y]
    while x is not y:
        if x.depth >= y.depth:
            left.append(x.edit)
            x = x.parent
        else:
            right.append(y.edit)
            y = y.parent
    return left[::-1] < right[::-1]


class Repair:
    """Survivors of one conversation: for each state the cheapest edits that end there, least in ASCII among equals. What all of them share is emitted and forgotten."""

    def __init__(self, emit: Callable[[str, tuple[str, str] | None], None]):
        self.emit, self.root, self.unresolved = emit, Step(None, "", None), 1
        self.at: dict[int, tuple[int, Step]] = {NONE: (0, self.root)}
        self.root.refs = 1
        self._insert()

    def _release(self, step: Step):
        step.refs -= 1
        while not step.refs and step.parent:
            step.parent.refs -= 1
            self.unresolved -= 1
            step.parent, step = None, step.parent

    def _pin(self, state: int, cost: int, parent: Step, edit: str, row):
        step = Step(parent, edit, row)
        step.refs, self.unresolved = 1, self.unresolved + 1
        old = self.at.get(state)
        self.at[state] = (cost, step)
        if old:
            self._release(old[1])

    def _insert(self):
        for target, sources in ((USER, (NONE, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best = None
            for s in sources:
                if s in self.at:
                    cost, step = self.at[s]
                    new = (cost + INSERT, step, "I")
                    if best is None or new[0] < best[0] or (new[0] == best[0] and before(new[1:], best[1:])):
                        best = new
            have = self.at.get(target)
            if best and (have is None or best[0] < have[0] or (best[0] == have[0] and before(best[1:], (have[1].parent, have[1].edit)))):
                self._pin(target, *best, ("user" if target == USER else "assistant", ""))
        for x in list(self.at):
            if any(y != x and self.at[y][0] + DETOUR[x, y] < self.at[x][0] for y in self.at):       # no continuation makes it the cheapest
                self._release(self.at.pop(x)[1])

    def add(self, initial: str, role: str, text: str, delete: bool, truncated: bool):
        """One more row; ``delete``: it has to go."""
        more, best = TRUNCATED if truncated else 0, {}
        for state, (cost, step) in self.at.items():
            options = [(state, cost + DELETE, step, "D", None)]
            if not delete:
                options += [(to, cost + more + REROLE, step, "R", (NAMES[i], text)) for i, to in MOVES[state].items() if i in NAMES]
                if initial in MOVES[state]:
                    options.append((MOVES[state][initial], cost + more, step, "K", (role, text)))
            for to, *new in options:
                old = best.get(to)
                if old is None or new[0] < old[0] or (new[0] == old[0] and before((new[1], new[2]), (old[1], old[2]))):
                    best[to] = new
        last, self.at = self.at, {}
        for to, new in best.items():
            self._pin(to, *new)
        for _, step in last.values():
            self._release(step)
        self._insert()
        self._settle()

    def _settle(self):
        """Emit the steps that every survivor rests on: the way from the root down to where survivors part or end."""
        if self.root.refs > 1 or any(step is self.root for _, step in self.at.values()):
            return
        way, step = [], min((s for _, s in self.at.values()), key=lambda s: s.depth)
        while step is not self.root:
            way.append(step)
            step = step.parent
        for step in reversed(way):
            if self.root.refs > 1 or any(s is self.root for _, s in self.at.values()):
                break
            self.emit(step.edit, step.row)
            self.root, step.parent, step.row = step, None, None
            self.unresolved -= 1

    def finish(self) -> int:
        """Emit the rest of the cheapest sequence that ends the pattern; its cost."""
        ends = [self.at[s] for s in (NONE, ASSISTANT) if s in self.at]
        best = ends[0]
        for other in ends[1:]:
            if other[0] < best[0] or (other[0] == best[0] and before((other[1], ""), (best[1], ""))):
                best = other
        way, step = [], best[1]
        while step is not self.root:
            way.append(step)
            step = step.parent
        for step in reversed(way):
            self.emit(step.edit, step.row)
        return best[0]


def _stream(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with their faults, each conversation in one partition in order of turn."""
    work = rows.select(rows[f"`{conv_col}`"].alias("conv_id"), rows[f"`{turn_col}`"].cast("long").alias("turn"), *[F.coalesce(rows[f"`{c}`"].cast("string"), F.lit(" ")).alias(k) for c, k in ((role_col, "role"), (text_col, "text"))])
    work = work.withColumn("_a", F.xxhash64("role", "text")).withColumn("_b", F.xxhash64(F.lit("second"), "role", "text"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = work.groupBy("conv_id", "_a", "_b").agg(F.min(turn).alias("_first"), F.max(turn).alias("_last")).where("_first <> _last")
    again = again.select(F.col("conv_id").alias("_c"), F.col("_a").alias("_x"), F.col("_b").alias("_y"), "_first")
    met = work.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "left")
    bare = F.btrim("text", F.lit(SPACE))
    flags = met.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), F.coalesce(turn > F.col("_first"), F.lit(False)).alias("again"),
                       (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    return flags.repartition(spread(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


class Conversation:
    """Counts over the rows of one conversation, and its repair."""

    def __init__(self, conv, emit):
        self.conv, self.emit, self.repair = conv, emit, Repair(self._edit)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.row = None
        self.audit, self.kept, self.digest = bytearray(), 0, hashlib.sha256()

    def _edit(self, edit, row):
        if row:
            self.digest.update(("\n" if self.kept else "").encode() + f"{row[0]}:{row[1]}".encode())
            self.kept += 1
        self.audit += edit.encode()
        if self.emit:
            self.emit((self.conv, len(self.audit), edit, *(row or (None, None))))

    def add(self, r: dict):
        repeated = r["again"] or (self.row is not None and all(r[k] == self.row[k] for k in ("turn", "role", "text")))
        cut = not r["blank"] and not repeated and r["truncated"]
        self.blank, self.duplicate, self.truncated = self.blank + r["blank"], self.duplicate + (repeated and not r["blank"]), self.truncated + cut
        self.illegal += self.row is not None and self.row["initial"] + r["initial"] not in LEGAL
        if r["turn"] is not None and r["turn"] != self.last:
            self.first, self.last, self.turns = r["turn"] if self.first is None else self.first, r["turn"], self.turns + 1
        self.row = r
        self.repair.add(r["initial"], r["role"], r["text"], r["blank"] or repeated, cut)

    def summary(self) -> tuple:
        cost = self.repair.finish()
        gaps = min(self.last - self.first + 1 - self.turns, LONGEST) if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), self.digest.hexdigest()


def _run(rows: DataFrame, schema: T.StructType, edits: bool, *cols: str) -> DataFrame:
    def repair(batches):
        now, out, held = None, [], 0

        def emit(row):
            nonlocal held
            out.append(row)
            held += sum(len(x) for x in row[-2:] if x) + 64

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        types, names = None, [f.name for f in schema.fields]
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, *((pa.int64(), pa.string(), pa.string(), pa.string()) if edits else (pa.int64(),) * 6 + (pa.string(),) * 2)]
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    if now:
                        done = now.summary()
                        if not edits:
                            emit(done)
                    now = Conversation(r["conv_id"], emit if edits else None)
                now.add(r)
                if held > 1 << 22:
                    yield full()
                    out.clear()
                    held = 0
        if now:
            done = now.summary()
            if not edits:
                emit(done)
        if out:
            yield full()

    return _stream(rows, *cols).mapInArrow(repair, schema)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, step, edit, role, text: the edits of every conversation in order; role and text of the rows that are left (kept, given another role, inserted), null for deleted ones.

    The rules are those of ``audited``. Without the deleted steps this is the repaired table.
    """
    schema = T.StructType([T.StructField("conv_id", rows.schema[conv_col].dataType), T.StructField("step", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]])
    return _run(rows, schema, True, conv_col, turn_col, role_col, text_col)


def audited(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn, nulls first, and within a turn by role and text. A row's first fault counts: blank (no text but white space), duplicate (role and text came
    earlier), truncated (the last character but white space is none of ``.!?``). gaps counts missing turns between the least and the largest, illegal adjacent rows whose roles
    may not follow each other.

    Edits: keep (0), give another role (1), delete (2; blank and duplicate rows have to go), insert an empty user or assistant row (5). A truncated row that stays costs 5 more. The
    cheapest edits whose roles read ``(s?(ua)+)?`` are taken, of equal ones those whose initials are least in ASCII. A Viterbi search keeps for each of the pattern's four states the best
    edits so far as a tree of steps with reference counts; steps that every survivor rests on are emitted at once. States that no continuation can make the cheapest are dropped: their cost
    exceeds another's by more than any detour. So memory holds the unresolved steps and not the conversation; equal costs are compared over all of the steps in which they differ. A
    conversation is a stream of rows in one task: its digest and its edits depend on all rows before.

    Earlier equal rows are found by an aggregation over (conversation, hash of role and text), not in the stream. Null roles and texts count as one space (so such texts are blank), a role
    that begins with none of s, u, a cannot be kept, and a null conversation id is one conversation. Texts may be of any length. Rows that are equal in all columns are duplicates. An
    empty table gives no rows.
    """
    schema = T.StructType([T.StructField("conv_id", rows.schema[conv_col].dataType), *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                           *[T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]])
    return _run(rows, schema, False, conv_col, turn_col, role_col, text_col)


def with_lost(summary: DataFrame, rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The result of ``audited`` with a row for every conversation of ``rows``: those without a row left have zeros, an empty audit and the digest of nothing."""
    every = rows.select(rows[f"`{conv_col}`"].alias("_every")).distinct()
    met = every.join(summary, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    return met.select(F.col("_every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in summary.columns[1:7]], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
