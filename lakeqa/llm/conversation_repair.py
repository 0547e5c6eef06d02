"""Faults of conversations and their cheapest repair, by min-plus steps over runs of equal turns."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# States of a repaired prefix: nothing yet, a system turn, a user's turn last, an assistant's last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# The turn that may be inserted, or that a turn may be changed to, in each state; and where it leads.
FORCED = ("user", "user", "assistant", "user")
AFTER_FORCED = (USER, USER, ASSISTANT, USER)
INITIALS = "sua"
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
MUST_GO = 8
RECAST, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
INFINITE = 1 << 60
BLOCK = 64
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def symbol(initial: int, fault: bool, cut_off: bool) -> int:
    """A turn as the repair sees it: its role's initial and whether it is cut off, or that it must go."""
    return MUST_GO if fault else 2 * initial + cut_off


def choices(sign: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn in ASCII order: letter, cost, next state."""
    yield "D", DELETE, state
    if sign != MUST_GO:
        initial, cut_off = divmod(sign, 2)
        if state in KEPT[initial]:
            yield "K", CUT_OFF * cut_off, KEPT[initial][state]
        yield "R", RECAST + CUT_OFF * cut_off, AFTER_FORCED[state]


def _times(a: list, b: list) -> list:
    return [[min(INFINITE, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES] for i in STATES]


def _insertions() -> list:
    step = [[0 if i == j else INSERT if AFTER_FORCED[i] == j else INFINITE for j in STATES] for i in STATES]
    return _times(step, _times(step, step))


INSERTIONS = _insertions()
# Costs from each state to an end: nothing at all, or an assistant's turn last.
ENDING = tuple(min(INSERTIONS[i][START], INSERTIONS[i][ASSISTANT]) for i in STATES)


class Transitions:
    """Min-plus matrices of insertions and one turn, and their powers 2, 4, 8 and so on, kept once made."""

    def __init__(self):
        self.kept: dict[tuple[int, int], list] = {}

    def power(self, sign: int, exponent: int) -> list:
        """The matrix of 2**exponent turns of one kind."""
        key = (sign, exponent)
        if key not in self.kept:
            if exponent:
                half = self.power(sign, exponent - 1)
                self.kept[key] = _times(half, half)
            else:
                turn = [[INFINITE] * 4 for _ in STATES]
                for state in STATES:
                    for _, cost, then in choices(sign, state):
                        turn[state][then] = min(turn[state][then], cost)
                self.kept[key] = _times(INSERTIONS, turn)
        return self.kept[key]

    def before(self, sign: int, count: int, after: tuple) -> tuple:
        """Least costs from each state before ``count`` turns of one kind, given those after them."""
        exponent = 0
        while count:
            if count & 1:
                after = _applied(self.power(sign, exponent), after)
            count >>= 1
            exponent += 1
        return after


def _applied(matrix: list, after: tuple) -> tuple:
    a, b, c, d = after
    return tuple(min(r[0] + a, r[1] + b, r[2] + c, r[3] + d) for r in matrix)


class Repair:
    """The cheapest edits of one conversation, ASCII-least of equally cheap ones, from its runs of symbols."""

    def __init__(self, transitions: Transitions):
        self.transitions = transitions
        self.signs, self.counts = array("b"), array("q")

    def add(self, sign: int) -> None:
        if self.signs and self.signs[-1] == sign:
            self.counts[-1] += 1
        else:
            self.signs.append(sign)
            self.counts.append(1)

    def solve(self) -> tuple[int, bytearray]:
        """Cost and edits: one of K, R, D for each turn, I before it or at the end for each inserted one."""
        table, after = array("q", ENDING), ENDING
        for sign, count in zip(reversed(self.signs), reversed(self.counts), strict=True):
            after = self.transitions.before(sign, count, after)
            table.extend(after)
        edits, state, cost = bytearray(), START, after[START]
        for run, (sign, count) in enumerate(zip(self.signs, self.counts, strict=True)):
            at = 4 * (len(self.signs) - run - 1)
            state = self._unroll(sign, count, tuple(table[at : at + 4]), state, edits)
        edits.extend(b"I" * (ENDING[state] // INSERT))
        return cost, edits

    def _unroll(self, sign: int, count: int, after: tuple, state: int, edits: bytearray) -> int:
        """Appends the edits of a run; the costs inside it are made anew, at most ``BLOCK`` at a time."""
        if count > BLOCK:
            exponent = (count - 1).bit_length() - 1
            middle = _applied(self.transitions.power(sign, exponent), after)
            state = self._unroll(sign, count - (1 << exponent), middle, state, edits)
            return self._unroll(sign, 1 << exponent, after, state, edits)
        costs, matrix = [after], self.transitions.power(sign, 0)
        for _ in range(count):
            costs.append(_applied(matrix, costs[-1]))
        for done in range(count, 0, -1):
            here, behind = costs[done], costs[done - 1]
            while True:
                # In ASCII order: delete, insert, keep, change the role.
                picked = next(
                    c for c in self._options(sign, state) if c[1] + (here if c[0] == "I" else behind)[c[2]] == here[state]
                )
                edits.append(ord(picked[0]))
                state = picked[2]
                if picked[0] != "I":
                    break
        return state

    @staticmethod
    def _options(sign: int, state: int) -> Iterator[tuple[str, int, int]]:
        for option in choices(sign, state):
            yield option
            if option[0] == "D":
                yield "I", INSERT, AFTER_FORCED[state]


class _Reader:
    """One conversation of the sorted stream: first its turns without texts, then with them."""

    def __init__(self, conv_id: int | None, transitions: Transitions):
        self.conv_id = conv_id
        self.repair = Repair(transitions)
        self.seen: set[bytes] = set()
        self.first = self.last = self.initial = self.edits = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.state, self.at, self.place = START, 0, 0

    def look(self, turn: int | None, role: str, same: bytes, blank: bool, open_end: bool) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns += 1
                self.last = turn
        duplicate = not blank and same in self.seen
        self.seen.add(same)
        truncated = open_end and not blank and not duplicate
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        kind = INITIALS.find(initial) if initial else -1
        self.repair.add(symbol(kind if kind >= 0 else 3, blank or duplicate, truncated))

    def solve(self) -> None:
        self.seen.clear()
        self.cost, self.edits = self.repair.solve()

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == ord("I"):
            yield "I", FORCED[self.state], ""
            self.state = AFTER_FORCED[self.state]
            self.at += 1

    def pass_on(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what stands in a turn's place, with the turns inserted before it."""
        yield from self._inserted()
        edit = chr(self.edits[self.at])
        self.at += 1
        if edit == "R":
            role, self.state = FORCED[self.state], AFTER_FORCED[self.state]
        elif edit == "K":
            self.state = KEPT[INITIALS.index(role[0])][self.state]
        if edit != "D":
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def _stream(turns: DataFrame, present: str | None) -> DataFrame:
    """Each turn twice, without and with its text, the conversation's turns in order and by one task.

    The texts pass the task one after the other, so however long a conversation is, only its runs,
    edits and 32 bytes for each different turn are held.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    )
    tail = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    marked = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "present",
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"),
        (tail == "").alias("blank"),
        (~tail.isin(".", "!", "?")).alias("open_end"),
    )
    both = marked.withColumn(
        "pass", F.explode(F.when(F.col("present"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("text", F.when(F.col("pass") == 1, F.col("text")))
    order = ["conv_id", "pass", F.col("turn").asc_nulls_first(), "role", "same"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "pass", "turn", "role", "text", "present", "same", "blank", "open_end"
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Reader, Iterator[tuple[str, str]]]]:
    """Conversations of a sorted stream, each with the role and text of its turns, still to be read."""
    transitions = Transitions()
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        reader = _Reader(row[0], transitions)
        while row is not None and row[0] == reader.conv_id and row[1] == 0:
            if row[5]:
                reader.look(row[2], row[3], *row[6:])
            row = next(rows, None)
        reader.solve()

        def texts(conv_id=reader.conv_id):
            nonlocal row
            while row is not None and row[0] == conv_id and row[1] == 1:
                yield row[3], row[4]
                row = next(rows, None)

        yield reader, texts()


def repair(turns: DataFrame, present: str | None = None) -> DataFrame:
    """Faults and cheapest repair of every conversation in ``turns`` (conv_id, turn, role, text), a row each.

    Turns go by ``turn`` (null first), those of one number by role, then by a digest of role and
    text; repeated rows are adjacent. A null role or text is one space, a null conv_id one
    conversation. A turn's first fault counts: blank, duplicate of an earlier role and text,
    truncated (no mark at its end). Repaired roles start with ``(s?(ua)+)?``; a role of no
    characters is none of these. Keeping a turn costs 0, another role (user or assistant) 2, a
    deletion 3, needed for blank and duplicate turns, an inserted empty turn 2; a truncated turn
    that stays costs 1 more. ``audit`` has K, R, D or I for each edit in order: of the cheapest
    the one that is ASCII-least. Rows whose column ``present`` (if named) is not true only name
    their conversation. Other columns are not looked at; an empty table gives no row.

    Returns conv_id, gaps (numbers missing between the smallest and largest), blank, duplicate,
    truncated, illegal (adjacent initials not su, ua or au), cost, audit, and repaired_sha256, over
    the repaired ``role:text`` joined by newlines. As this hash and the audit are one value a
    conversation, made in order, a conversation is read by one task, as a stream from a sort that
    may spill; its texts are not held.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for reader, texts in _conversations(batches):
            total, first = hashlib.sha256(), True

            def add(pieces):
                nonlocal first
                for _, role, text in pieces:
                    total.update((("" if first else "\n") + f"{role}:{text}").encode())
                    first = False

            for role, text in texts:
                add(reader.pass_on(role, text))
            add(reader.end())
            out.append((reader.conv_id, *(getattr(reader, n) for n in names), reader.edits.decode(), total.hexdigest()))
            held += len(reader.edits) + 200
            if held > 4 << 20:
                yield _batch(out, schema)
                out, held = [], 0
        if out:
            yield _batch(out, schema)

    fields = "conv_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", audit string, repaired_sha256 string"
    return _stream(turns, present).mapInArrow(digest, fields)


def repaired_turns(turns: DataFrame, present: str | None = None) -> DataFrame:
    """The turns that the cheapest repair of each conversation leaves: conv_id, place, edit, role, text.

    ``place`` counts from 0 in each conversation, ``edit`` is K, R or I; the rest is as in ``repair``.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for reader, texts in _conversations(batches):

            def pieces():
                for role, text in texts:
                    yield from reader.pass_on(role, text)
                yield from reader.end()

            for place, (edit, role, text) in enumerate(pieces()):
                out.append((reader.conv_id, place, edit, role, text))
                held += len(text) + 100
                if held > 4 << 20:
                    yield _batch(out, schema)
                    out, held = [], 0
        if out:
            yield _batch(out, schema)

    return _stream(turns, present).mapInArrow(rewrite, "conv_id bigint, place bigint, edit string, role string, text string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
