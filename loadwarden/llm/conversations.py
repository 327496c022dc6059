"""Repair of the structure of conversations by Knuth's lightest derivation.

A conversation is rows (turn, role, text). Its repair is a row of edits: Keep a row (0), Rerole it to user or assistant (2), Delete it (3, and a must for blank and
duplicate rows), Insert an empty user or assistant text anywhere (2); a truncated row that stays adds 1. The role initials that come out must match (s?(ua)+)?. The audit
is the initials of the edits; of the cheapest repairs that with the ASCII-least audit is made.

The repairs are derivations of a weighted hypergraph. Its items are (rows left behind, state), where the state says which initials may follow; its deductions
combine an edit of a row, an axiom with the edit's weight and letter, with the item that the edit leads to, so derivations grow from the end of the
conversation to its beginning. The function of a deduction adds the weight to the cost and puts the letter before the audit. It is monotone, and superior in
the order (cost, rows used, audit): an edit without cost uses a row. So items come off the agenda in that order, each for good at its first time, and the search ends
with the goal item. From a state, a letter leads to one item only; audits of one item therefore differ in their first letters, or agree, and the letter is all that is compared and kept.

Conversations are spread by ranges of (conversation, turn, hash of the row). One that a task sees from beginning to end is repaired there. The first and the last one of a task may go
on in its neighbours, and one of very many rows is not held: these are handed on as segments of bounded size. A segment is repaired for each pair of states around
it, the pairs compose like matrices from the last segment to the first, and the chosen audit goes back to the segments. So no task holds more rows than a
segment; a whole repaired conversation stands in one row of the result, as its audit does.

Rows follow their turns, nulls first; rows of one turn follow the hash of role and text, repeated rows in any order, as they are equal. Null texts, roles, turns and
conversation ids count as one space where text is read, while null turns leave gaps alone and rows of a null id are one conversation. Empty texts are blank. Roles are told by
their first character. An empty table gives an empty table; columns other than conv_id, turn, role and text are not read, whatever they are called.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwarden.session import write_through

#: States: nothing yet, after a system row, an assistant must follow, a user may follow.
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = (START, SYSTEM, ASKED, ANSWERED)
#: Where a conversation may end.
FINAL = (START, ANSWERED)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
WHITE = " \t\n\v\f\r"
#: Rows and characters of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 4 << 20
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


def fault(text: str, seen_before: bool) -> str | None:
    """The first fault of a row."""
    end = text.rstrip(WHITE)[-1:]
    return BLANK if not end else DUPLICATE if seen_before else None if end in ".!?" else TRUNCATED


def _before(state: int) -> list[tuple[int, str]]:
    """(state, role initial) pairs from which a row of that initial leads to `state`."""
    return {START: [], SYSTEM: [(START, "s")], ASKED: [(START, "u"), (SYSTEM, "u"), (ANSWERED, "u")], ANSWERED: [(ASKED, "a")]}[state]


BEFORE = {s: _before(s) for s in STATES}
AFTER = {(b, role): s for s in STATES for b, role in BEFORE[s]}


def lightest(rows: list[tuple[str, str | None]], ends: tuple[int, ...], goals: tuple[int, ...] = (START,)) -> dict[int, tuple[int, str]]:
    """For each state in `goals`, (cost, audit) of the lightest way over the rows (role initial, fault) that begins in it and ends in one
    of `ends`. An item is (row, state): the rows from there on are repaired."""
    n = len(rows)
    chosen: dict[int, tuple[str, int]] = {}  # item -> letter and item after it; items are row * 4 + state
    cost_of: dict[int, int] = {}
    agenda = [(0, 0, "", n * 4 + s, -1) for s in ends]
    open_goals = set(goals)
    while agenda and open_goals:
        cost, used, letter, item, after = heapq.heappop(agenda)
        if item in cost_of:
            continue
        cost_of[item], chosen[item] = cost, (letter, after)
        row, state = divmod(item, 4)
        if not row:
            open_goals.discard(state)
        for earlier, role in BEFORE[state]:
            if role != "s":
                at = row * 4 + earlier
                if at not in cost_of:
                    heapq.heappush(agenda, (cost + INSERT, used, "I", at, item))
        if row:
            initial, wrong = rows[row - 1]
            at = (row - 1) * 4 + state
            heapq.heappush(agenda, (cost + DELETE, used + 1, "D", at, item))
            if wrong is None or wrong == TRUNCATED:
                stays = cost + (CUT_OFF if wrong else 0)
                for earlier, role in BEFORE[state]:
                    at = (row - 1) * 4 + earlier
                    if role == initial:
                        heapq.heappush(agenda, (stays + KEEP, used + 1, "K", at, item))
                    if role != "s":
                        heapq.heappush(agenda, (stays + REROLE, used + 1, "R", at, item))
    out = {}
    for goal in goals:
        if goal in cost_of:
            letters, item = [], goal
            while item >= 0:
                letter, after = chosen[item]
                letters.append(letter)
                item = after
            out[goal] = cost_of[goal], "".join(letters)
    return out


def apply_audit(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The repaired (role, text) rows."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            initial, turn = rows[at][0][:1], rows[at]
        else:
            initial = "a" if state == ASKED else "u"
            turn = "assistant" if initial == "a" else "user", rows[at][1] if letter == "R" else ""
        at += letter != "I"
        state = AFTER[state, initial]
        out.append(turn)
    return out


def counts(turns: list[int | None], faults: list[str | None], initials: list[str]) -> dict:
    """What adds up over segments: least and largest turn, different turns, rows of each fault, role initials that may not follow each other, and the ends."""
    known = [t for t in turns if t is not None]
    return {"low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
            **{f: faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None}


def joined(parts: list[dict]) -> dict:
    """Counts of segments in order; a turn may go on from one into the next."""
    out = {f: sum(p[f] for p in parts) for f in (BLANK, DUPLICATE, TRUNCATED, "illegal")}
    spans = [p for p in parts if p["low"] is not None]
    different = sum(p["turns"] for p in spans) - sum(a["high"] == b["low"] for a, b in zip(spans, spans[1:]))
    filled = [p for p in parts if p["first_initial"] is not None]
    out["illegal"] += sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(filled, filled[1:]))
    out["gaps"] = spans[-1]["high"] - spans[0]["low"] + 1 - different if spans else 0
    return out


def compose(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and the state before and the audit of every segment, of the lightest way through all of them; `tables` has (cost, audit) for
    pairs of states around a segment. Whole audits are compared, as they are complete to the end."""
    best = {s: (0, "", ()) for s in FINAL}
    for table in reversed(tables):
        found = {}
        for (before, after), (cost, audit) in table.items():
            if after in best:
                rest = best[after]
                way = (cost + rest[0], audit + rest[1], (before, audit, rest[2]))
                if before not in found or way[:2] < found[before][:2]:
                    found[before] = way
        best = found
    cost, _, chain = best[START]
    steps = []
    while chain:
        before, audit, chain = chain
        steps.append((before, audit))
    return cost, steps


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string"
_TABLE = "table array<struct<before: int, after: int, cost: long, audit: string>>"


def damage(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """The rows with seeded faults: crc32 of `conv_id:turn` modulo `modulus` drops a row (0), empties its text (1), takes its sentence ends (2), repeats it (3) or makes its
    role user (4). Dropped rows stay with a null text, so that their conversations are known."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    draw = F.crc32(key.cast("binary")) % modulus
    text = F.coalesce("text", blank)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
                                F.when(draw == 0, F.lit(None)).when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                                F.explode(F.array_repeat(F.lit(1), F.when(draw == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


class _Segments:
    """Cuts the rows of a task into conversations and segments."""

    def __init__(self, most_rows: int, most_chars: int):
        self.most_rows, self.most_chars = most_rows, most_chars
        self.key, self.first, self.long = None, True, False
        self.rows: list[tuple] = []
        self.chars, self.any, self.number = 0, False, 0

    def add(self, key, turn, role, text):
        """Yields (whether whole, key, number, rows) of what is finished."""
        if self.any and key != self.key:
            yield self._out(not self.first and not self.long)
            self.first, self.long = False, False
        elif len(self.rows) >= self.most_rows or self.chars >= self.most_chars:
            self.long = True
            yield self._out(False)
        self.key, self.any = key, True
        if text is not None:
            self.rows.append((turn, role, text))
            self.chars += len(text)

    def _out(self, whole: bool):
        out = whole, self.key, self.number, self.rows
        self.number, self.rows, self.chars = self.number + 1, [], 0
        return out

    def end(self):
        if self.any:
            yield self._out(False)


def _whole(rows: list[tuple]) -> dict:
    """The result of a conversation whose rows are all here."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = lightest(list(zip(initials, faults)), FINAL)[START]
    turns = apply_audit([r[1:] for r in rows], audit)
    return joined([counts([t for t, _, _ in rows], faults, initials)]) | {
        "cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in turns]}


def _first_pass(most_rows: int, most_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segments = TaskContext.get().partitionId(), _Segments(most_rows, most_chars)
        waiting, chars = [], 0
        kind = None

        def written():
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
            return pa.RecordBatch.from_arrays(
                [pa.array([w[0] for w in waiting], kind), pa.array([part] * len(waiting), pa.int32()), pa.array([w[1] for w in waiting], pa.int32()),
                 pa.array([w[2] is not None for w in waiting]), *(pa.array([w[2] and w[2][n] for w in waiting], pa.int64()) for n in names),
                 pa.array([w[2] and w[2]["audit"] for w in waiting], pa.string()), pa.array([w[2] and w[2]["repaired"] for w in waiting], _TURNS),
                 pa.array([w[3] for w in waiting], _ROWS)],
                names=["conv_id", "part", "number", "whole", *names, "audit", "repaired", "rows"])

        def cut():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                for at in range(0, batch.num_rows, 1024):
                    for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns[:4])):
                        yield from segments.add(*row)
            yield from segments.end()

        for whole, key, number, rows in cut():
            done = _whole(rows) if whole else None
            waiting.append((key, number, done, None if whole else [dict(zip(("turn", "role", "text"), r)) for r in rows]))
            chars += 64 + sum(len(t) for _, _, t in rows)
            if chars >= most_chars:
                yield written()
                waiting, chars = [], 0
        if waiting:
            yield written()
    return run


def _segment_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and the lightest ways of every segment, for each pair of states around it."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            rows, firsts = row.column("rows")[0].as_py(), set(row.column("firsts")[0].as_py() or [])
            faults = [fault(r["text"], k not in firsts) for k, r in enumerate(rows)]
            initials = [r["role"][:1] for r in rows]
            found = counts([r["turn"] for r in rows], faults, initials)
            table = [{"before": before, "after": after, "cost": cost, "audit": audit} for after in STATES
                     for before, (cost, audit) in lightest(list(zip(initials, faults)), (after,), STATES).items()]
            kinds = [pa.string() if c.endswith("initial") else pa.int64() for c in found]
            yield pa.RecordBatch.from_arrays(
                [row.column("conv_id"), row.column("part"), row.column("number"), *(pa.array([v], k) for v, k in zip(found.values(), kinds)),
                 pa.array([table], pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))],
                names=["conv_id", "part", "number", *found, "table"])


def _compose_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of every conversation and the way through its segments."""
    steps_type = pa.list_(pa.struct([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int32()), ("audit", pa.string())]))
    for batch in batches:
        for at in range(batch.num_rows):
            segments = batch.column("segments")[at].as_py()
            totals = joined(segments)
            cost, steps = compose([{(w["before"], w["after"]): (w["cost"], w["audit"]) for w in s["table"]} for s in segments])
            way = [{"part": s["part"], "number": s["number"], "before": before, "audit": audit} for s, (before, audit) in zip(segments, steps)]
            names = ["gaps", "blank", "duplicate", "truncated", "illegal"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").slice(at, 1), *(pa.array([totals[n]], pa.int64()) for n in names), pa.array([cost], pa.int64()),
                 pa.array(["".join(audit for _, audit in steps)]), pa.array([way], steps_type)], names=["conv_id", *names, "cost", "audit", "steps"])


def _apply_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            rows = [(r["role"], r["text"]) for r in row.column("rows")[0].as_py()]
            turns = apply_audit(rows, row.column("audit")[0].as_py(), row.column("before")[0].as_py())
            yield pa.RecordBatch.from_arrays([row.column("conv_id"), row.column("part"), row.column("number"), pa.array([[{"role": r, "text": t} for r, t in turns]], _TURNS)],
                                             names=["conv_id", "part", "number", "repaired"])


def repair(rows: DataFrame, most_rows: int = SEGMENT_ROWS, most_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (the turns as array of role and text). Rows with a null
    text only name their conversation. `most_rows` and `most_chars` bound a segment."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "sig"]
    # what is drawn for the ranges is ids and hashes, not texts
    sorted_rows = (rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), "text", F.xxhash64("role", "text").alias("sig"))
                   .repartitionByRange(ranges, *order).sortWithinPartitions(*order, "role", "text"))
    turns = "array<struct<role: string, text: string>>"
    first = write_through(sorted_rows.select("conv_id", "turn", "role", "text").mapInArrow(
        _first_pass(most_rows, most_chars), f"conv_id {kind}, part int, number int, whole boolean, {_TOTALS}, repaired {turns}, "
        "rows array<struct<turn: long, role: string, text: string>>"), "conversations")
    names = ["conv_id", *[c.split(" ")[0] for c in _TOTALS.split(", ")], "repaired"]
    done = first.where("whole").select(*names)
    segments = first.where("NOT whole").select("conv_id", "part", "number", "rows")
    place = ["part", "number"]
    # the first row of each role and text in a conversation, from digests alone
    each = segments.select("conv_id", *place, F.posexplode("rows").alias("pos", "r"))
    firsts = (each.groupBy("conv_id", F.col("r.role").alias("role"), F.sha2("r.text", 256).alias("digest")).agg(F.min(F.struct(*place, "pos")).alias("at"))
              .groupBy("at.part", "at.number").agg(F.collect_list("at.pos").alias("firsts")))
    solved = segments.join(firsts, place, "left").select("conv_id", *place, "rows", "firsts").mapInArrow(
        _segment_pass, f"conv_id {kind}, part int, number int, {_COUNTS}, {_TABLE}")
    lists = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*place, *[c for c in solved.columns if c not in ("conv_id", *place)]))).alias("segments"))
    ways = write_through(lists.mapInArrow(_compose_pass, f"conv_id {kind}, {_TOTALS}, steps array<struct<part: int, number: int, before: int, audit: string>>"), "conversation-ways")
    steps = ways.select(F.inline("steps")).select(*place, "before", "audit")
    repaired = segments.join(steps, place).select("conv_id", *place, "rows", "before", "audit").mapInArrow(
        _apply_pass, f"conv_id {kind}, part int, number int, repaired {turns}")
    texts = repaired.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*place, "repaired"))), lambda s: s["repaired"])).alias("repaired"))
    open_done = ways.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*names)
    return done.unionByName(open_done)
