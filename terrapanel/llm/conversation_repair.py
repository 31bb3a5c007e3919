"""Conversation structure repair by depth-first branch-and-bound.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  Edits
of one turn: Keep (0), Rerole to user or assistant (1), Delete (2, required for
blank and duplicate turns); Insert of an empty user or assistant turn anywhere
(5); a truncated turn that is not deleted adds 5.  The wanted repair is the
cheapest, of equally cheap ones the one whose edit initials in order (the audit)
are ASCII-least.

Method: ``search`` walks prefixes of edits with an explicit stack, cheapest child
first.  A node is (turns done, state of the role pattern).  Each node keeps the
best (cost, audit) that reached it and drops worse prefixes; a suffix lower
bound (what every open turn costs at least) drops prefixes that can't beat the
incumbent (cost, audit); the search ends when no prefix is left, which proves
the incumbent optimal.  Cost follows from the audit and the turns, so no audit is
a prefix of another of equal cost, and the best repair is made of best parts: a
long conversation is searched in blocks of ``BLOCK`` turns, once for each state
it can enter a block in, and the blocks' results are joined state by state.

Turns are range-partitioned by (conversation, turn, role, text digest) and
written once with their position, so a conversation with a third of all rows lies
in many partitions; each gives a table of at most 4 x 4 results, and one fold a
conversation joins them.  Earlier copies of a turn are found by a grouped
minimum.  Only a conversation's audit, which the result holds in one value, is
ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import materialize

#: States of the role pattern: nothing kept, after s, after u, after a.
E, S, U, A = range(4)
AFTER = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
NEXT = (U, U, A, U)
REACHED = ((E, S, U, A), (S, U, A), (U, A), (U, A))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK = 48
#: Turns to a partition of the ordered table.
ROWS = 100_000
LONGEST = 2**63 - 1

Turn = tuple[str, bool, bool]  # role initial, must go, truncated
Found = dict[int, tuple[int, str]]  # state at the end -> (cost, audit)


def search(turns: list[Turn], entry: int, ends: bool) -> Found:
    """Best (cost, audit) to each state that ``turns`` can leave from ``entry``; only the best legal end if the conversation ``ends`` here."""
    n = len(turns)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        _, gone, cut = turns[i]
        least[i] = least[i + 1] + (DELETE if gone or cut else 0)
    best: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(0, "", 0, entry)]

    def hopeless(cost: int, audit: str, i: int, state: int) -> bool:
        """No end that this prefix can reach gets better through it."""
        bound = cost + least[i]
        if ends:
            limit = min((best[n, x] for x in (E, A) if (n, x) in best), default=None)
            return limit is not None and (bound > limit[0] or bound == limit[0] and audit > limit[1][:len(audit)])
        return all((n, x) in best and bound > best[n, x][0] for x in REACHED[state])

    while stack:
        cost, audit, i, state = stack.pop()
        if best[i, state] != (cost, audit) or hopeless(cost, audit, i, state):
            continue
        children = []
        if i < n:
            initial, gone, cut = turns[i]
            children.append((cost + DELETE, audit + "D", i + 1, state))
            if not gone:
                extra = TRUNCATED if cut else 0
                if (state, initial) in AFTER:
                    children.append((cost + KEEP + extra, audit + "K", i + 1, AFTER[state, initial]))
                if AFTER.get((state, initial)) != NEXT[state]:
                    children.append((cost + REROLE + extra, audit + "R", i + 1, NEXT[state]))
        children.append((cost + INSERT, audit + "I", i, NEXT[state]))
        children.sort(key=lambda c: (c[0] + least[c[2]], c[1]), reverse=True)
        for child in children:
            c, a, j, to = child
            if ((j, to) not in best or (c, a) < best[j, to]) and not hopeless(c, a, j, to):
                best[j, to] = (c, a)
                stack.append(child)
    return {x: best[n, x] for x in ((E, A) if ends else range(4)) if (n, x) in best}


def joined(first: dict[int, Found], second: dict[int, Found]) -> dict[int, Found]:
    """Results over two neighbouring runs of turns, by the state at the start of the first."""
    out: dict[int, Found] = {}
    for entry, middle in first.items():
        ways: Found = {}
        for state, (cost, audit) in middle.items():
            for end, (more, rest) in second.get(state, {}).items():
                way = (cost + more, audit + rest)
                if end not in ways or way < ways[end]:
                    ways[end] = way
        out[entry] = ways
    return out


class Run:
    """Results over the turns of one conversation in one partition, block by block."""

    def __init__(self, entries: tuple[int, ...]):
        self.done: dict[int, Found] = {x: {x: (0, "")} for x in entries}
        self.held: list[Turn] = []

    def add(self, turn: Turn) -> None:
        if len(self.held) == BLOCK:
            self.flush(False)
        self.held.append(turn)

    def flush(self, ends: bool) -> dict[int, Found]:
        starts = sorted({x for ways in self.done.values() for x in ways})
        self.done = joined(self.done, {x: search(self.held, x, ends) for x in starts})
        self.held = []
        return self.done


SEGMENT = "c string, part long, at long, ways array<struct<entry:int,exit:int,cost:long,audit:string>>, first string, last string, illegal long"
SLICE = "c string, part long, at long, entry int, audit string, piece int, cost long, illegal long"
TURN = "c string, at long, k long, edit string, role string, text string"
LEGAL = ("su", "ua", "au")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_SEGMENT = pa.schema([("c", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("ways", pa.list_(_WAY)), ("first", pa.string()),
                      ("last", pa.string()), ("illegal", pa.int64())])
_SLICE = pa.schema([("c", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("entry", pa.int32()), ("audit", pa.string()),
                    ("piece", pa.int32()), ("cost", pa.int64()), ("illegal", pa.int64())])
_TURN = pa.schema([("c", pa.string()), ("at", pa.int64()), ("k", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def solve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation in each partition: its ways through, and its adjacent illegal initials.

    Turns come sorted by position.  A conversation that isn't the first of its
    partition starts there; one that isn't the last ends there.
    """
    key = run = None
    opens = False
    start = illegal = 0
    first = last = ""

    def close(ends: bool) -> tuple:
        ways = run.flush(ends)
        return (*key, start, [{"entry": e, "exit": x, "cost": c, "audit": a} for e, found in ways.items() for x, (c, a) in found.items()],
                first, last, illegal)

    for b in batches:
        rows: list[tuple] = []
        for c, at, initial, gone, cut in zip(*(b.column(n).to_pylist() for n in ("c", "at", "initial", "gone", "truncated")), strict=True):
            part = at >> 33
            if key != (c, part):
                if key is not None:
                    rows.append(close(part == key[1]))
                opens = key is None or part != key[1]
                run = Run((E, S, U, A) if opens else (E,))
                key, start, illegal, first = (c, part), at, 0, initial
            elif last + initial not in LEGAL or len(last + initial) != 2:
                illegal += 1
            last = initial
            run.add((initial, gone, cut))
        if rows:
            yield _batch(rows, _SEGMENT)
    if key is not None:
        yield _batch([close(False)], _SEGMENT)


def fold_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the segments of each conversation in order and cuts its best audit back into their slices.

    Holds the four best audits of one conversation; paths to them are linked lists.
    """
    key, illegal, last = None, 0, ""
    best: dict[int, tuple[int, str, tuple | None]] = {}

    def close() -> list[tuple]:
        cost, audit, path = min((best[x] for x in (E, A) if x in best), key=lambda w: w[:2])
        pieces = []
        while path is not None:
            pieces.append(path[0])
            path = path[1]
        out, at = [], 0
        for i, (part, start, entry, size) in enumerate(reversed(pieces)):
            out.append((key, part, start, entry, audit[at:at + size], i, cost, illegal))
            at += size
        return out

    for b in batches:
        rows: list[tuple] = []
        for seg in b.to_pylist():
            if seg["c"] != key:
                if key is not None:
                    rows += close()
                key, illegal, best = seg["c"], 0, {E: (0, "", None)}
            elif last + seg["first"] not in LEGAL or len(last + seg["first"]) != 2:
                illegal += 1
            last = seg["last"]
            illegal += seg["illegal"]
            now: dict[int, tuple[int, str, tuple | None]] = {}
            for w in seg["ways"]:
                if w["entry"] in best:
                    cost, audit, path = best[w["entry"]]
                    way = (cost + w["cost"], audit + w["audit"])
                    if w["exit"] not in now or way < now[w["exit"]][:2]:
                        now[w["exit"]] = (*way, ((seg["part"], seg["at"], w["entry"], len(w["audit"])), path))
            best = now
        if rows:
            yield _batch(rows, _SLICE)
    if key is not None:
        yield _batch(close(), _SLICE)


def apply_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns after the edits (and deleted ones, edit D), from turns and slices sorted by position, a slice before its turns."""
    state, todo, done, c, at, k = E, "", 0, None, 0, 0

    def inserts(rows: list[tuple]) -> None:
        nonlocal state, done, k
        while done < len(todo) and todo[done] == "I":
            role = "assistant" if state == U else "user"
            state, done, k = NEXT[state], done + 1, k + 1
            rows.append((c, at, k, "I", role, ""))

    for b in batches:
        rows: list[tuple] = []
        for kind, b_c, b_at, entry, audit, role, text in zip(*(b.column(n).to_pylist() for n in ("kind", "c", "at", "entry", "audit", "role", "text")), strict=True):
            if kind == 0:
                inserts(rows)
                state, todo, done, c, at, k = entry, audit, 0, b_c, b_at, -len(audit) - 1
                continue
            inserts(rows)
            edit, done, at, k = todo[done], done + 1, b_at, 0
            if edit == "R":
                role, state = ("assistant" if state == U else "user"), NEXT[state]
            elif edit == "K":
                state = AFTER[state, role[:1]]
            rows.append((c, at, 0, edit, role, text))
            if done == len(todo) or todo[done] != "I":
                continue
            inserts(rows)
        yield _batch(rows, _TURN)
    rows = []
    inserts(rows)
    if rows:
        yield _batch(rows, _TURN)


@dataclass
class Repair:
    """``turns``: (conv_id, n, edit, role, text), every turn of the repaired conversations in order (n from 1) and deleted ones (n null).
    ``report``: one row a conversation, with faults, cost and audit."""

    turns: DataFrame
    report: DataFrame
    _placed: DataFrame
    _conv: Column


def conv_key(col: Column) -> Column:
    """Conversation ids as text, a null id told from all others."""
    return F.coalesce(F.concat(F.lit("v"), col.cast("string")), F.lit("n"))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Cheapest legal repair of every conversation.

    Turns are taken by ``turn`` (nulls first), turns of one number by role and
    text digest.  The first fault of a turn counts: blank (nothing but blanks),
    duplicate (role and text of an earlier turn), truncated (its last character
    other than blanks is not ``.``, ``!`` or ``?``).  ``report``: conv_id, gaps
    (missing numbers between the least and the greatest), blank, duplicate,
    truncated, illegal (adjacent initials other than su, ua, au), cost, audit.

    Edge cases: null roles and texts are one space, so such a turn is blank or
    has to be reroled or deleted.  A null id is a conversation of its own.  Null
    turns count nowhere in the gaps; without any number there are none; a range
    beyond the long numbers is cut to their greatest.  An empty role has no
    initial and is never kept.  Roles count by their initial, so ``unknown`` is
    kept as a user's.  Repeated rows are duplicates of one another.  A
    conversation without legal turns may lose all of them.  An empty table gives
    no rows; other columns are ignored.
    """
    spark = df.sparkSession
    conv_type = df.schema[conv_col].dataType
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in (role_col, text_col))
    rows = df.select(conv_key(F.col(conv_col)).alias("c"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("digest", digest).withColumn("tie", F.monotonically_increasing_id())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "digest", "tie"]
    ordered = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                          .select("c", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at")), "repair_turns")
    repeats = ordered.groupBy("c", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.when(F.col("role") == "", "?").otherwise(F.substring("role", 1, 1))
    facts = (ordered.select("c", "turn", "at", "digest", initial.alias("initial"), blank.alias("blank"), (~whole).alias("open"))
             .join(repeats, ["c", "digest"], "left")
             .withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
             .withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate")))
    facts = materialize(facts.select("c", "turn", "at", "initial", "blank", "duplicate", "truncated"), "repair_facts")

    part = F.shiftright("at", 33)
    segments = (facts.select("c", "at", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
                .repartition(n, part).sortWithinPartitions("at").mapInArrow(solve_parts, SEGMENT))
    slices = materialize(segments.repartition(n, "c").sortWithinPartitions("c", "part").mapInArrow(fold_conversations, SLICE), "repair_slices")

    null = lambda t: F.lit(None).cast(t)
    both = (slices.select("part", F.lit(0).alias("kind"), "c", "at", "entry", "audit", null("string").alias("role"), null("string").alias("text"))
            .unionAll(ordered.select(part.alias("part"), F.lit(1), "c", "at", null("int"), null("string"), "role", "text")))
    placed = materialize(both.repartition(n, "part").sortWithinPartitions("at", "kind").mapInArrow(apply_audits, TURN), "repair_applied")

    one = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    by_turn = facts.groupBy("c", "turn").agg(one("blank"), one("duplicate"), one("truncated"))
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("turn")
    gaps = F.when(F.count("turn") == 0, F.lit(0)).otherwise(F.coalesce(span.try_cast("long"), F.lit(LONGEST)))
    counts = by_turn.groupBy("c").agg(gaps.cast("long").alias("gaps"), one("blank"), one("duplicate"), one("truncated"))
    audits = slices.groupBy("c").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"),
                                     F.array_join(F.sort_array(F.collect_list(F.struct("piece", "audit")))["audit"], "").alias("audit"))
    conv = F.when(F.col("c") != "n", F.substring("c", 2, 2**31 - 1)).cast(conv_type)
    report = counts.join(audits, "c").select(conv.alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(_numbered(placed, n).select(conv.alias(conv_col), "n", "edit", "role", "text"), report, placed, conv)


def _numbered(placed: DataFrame, tasks: int) -> DataFrame:
    """Positions of the turns that stay, counted along the sorted rows of each conversation."""
    schema = "c string, n long, edit string, role string, text string"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for b in batches:
            out = []
            for c, edit in zip(b.column("c").to_pylist(), b.column("edit").to_pylist(), strict=True):
                key, n = c, (n if c == key else 0) + (edit != "D")
                out.append(None if edit == "D" else n)
            yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(out, pa.int64()), *(b.column(x) for x in ("edit", "role", "text"))],
                                             ["c", "n", "edit", "role", "text"])

    return placed.repartition(tasks, "c").sortWithinPartitions("c", "at", "k").mapInArrow(count, schema)


def digests(done: Repair, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of ``role:text`` of the repaired turns, newline-joined, fed turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, empty = None, None, True
        names = ["c", "repaired_sha256"]
        for b in batches:
            out: list[tuple[str, str]] = []
            for c, edit, role, text in zip(*(b.column(x).to_pylist() for x in ("c", "edit", "role", "text")), strict=True):
                if c != key:
                    if key is not None:
                        out.append((key, h.hexdigest()))
                    key, h, empty = c, hashlib.sha256(), True
                if edit != "D":
                    h.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names)

    placed = done._placed.repartition("c").sortWithinPartitions("c", "at", "k")
    return placed.mapInArrow(run, "c string, repaired_sha256 string").select(done._conv.alias(conv_col), "repaired_sha256")


def damage(df: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults drawn from ``crc32(conv_id:turn) % 20``; nulls there, in roles and texts are one space.

    0 drops a row, 1 empties its text, 2 takes its full stops, marks of
    exclamation and of question, 3 repeats it, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(blank("role"))
    out = df.select("conv_id", "turn", "role", "text", draw.alias("d")).filter("d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "d")
    copies = F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1))
    return out.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")
