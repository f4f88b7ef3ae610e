"""Repair of conversations by the cheapest edits, searched from both ends of the edit lattice.

A node of the lattice is a place between two turns together with the last role written so far; its edges keep, rerole,
delete or insert a turn. Two Dijkstra searches, one from the beginning and one from the legal ends, settle nodes until
their heaps together cost more than the best meeting found: every node of every cheapest path is settled by one of
them then. Their meeting points are traced back, and the least audit is read letter by letter from both sides.

Only a letter a turn is gathered per conversation, as the audit itself has; texts are shuffled once, sorted, and read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.session import ship_package

#: What an edit costs; a truncated turn that is not deleted adds ``TRUNCATED``. A conversation's audit has the initials of its edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Last role written: none yet, system, user, assistant. Legal ends are the first and the last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be inserted or reroled to next, which is also the role that follows.
NEXT = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (NONE, SYSTEM, ASSISTANT), (USER,))
#: Roles that a turn of an initial may be kept after, and what it then is.
KEPT = {"s": ((NONE,), SYSTEM), "u": ((NONE, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
FAR = 1 << 60
#: Conversations of up to so many turns have their solutions remembered: short ones repeat the same few marks.
REMEMBERED = 64

BLANK, DUPLICATE, CUT = 1, 2, 3
WRITTEN = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _edges_on(marks: str, node: int) -> Iterator[tuple[int, int, str]]:
    """Target, cost and letter of the edits that can follow a node; ``marks`` has a letter a turn, see ``cheapest_edits``."""
    place, last = divmod(node, 4)
    follows = NEXT[last]
    yield 4 * place + follows, INSERT, "I"
    if place == len(marks):
        return
    yield node + 4, DELETE, "D"
    mark = marks[place]
    if mark != "x":
        extra = TRUNCATED if mark.isupper() else 0
        after, role = KEPT.get(mark.lower(), ((), None))
        if last in after:
            yield 4 * place + 4 + role, extra, "K"
        yield 4 * place + 4 + follows, REROLE + extra, "R"


def _edges_back(marks: str, node: int) -> Iterator[tuple[int, int]]:
    """Source and cost of the edits that can lead to a node."""
    place, last = divmod(node, 4)
    for before in BEFORE[last]:
        yield 4 * place + before, INSERT
    if place == 0:
        return
    yield node - 4, DELETE
    mark, start = marks[place - 1], 4 * place - 4
    if mark != "x":
        extra = TRUNCATED if mark.isupper() else 0
        after, role = KEPT.get(mark.lower(), ((), None))
        if role == last:
            for before in after:
                yield start + before, extra
        for before in BEFORE[last]:
            yield start + before, REROLE + extra


def _meet(marks: str, ends: tuple[int, ...]) -> tuple[int, dict[int, int], dict[int, int]]:
    """The least cost, and the settled nodes of both searches with their distances."""
    known = ({0: 0}, dict.fromkeys(ends, 0))
    settled: tuple[dict[int, int], dict[int, int]] = ({}, {})
    heaps = ([(0, 0)], [(0, e) for e in ends])
    best = FAR
    while heaps[0] or heaps[1]:
        tops = [heap[0][0] if heap else FAR for heap in heaps]
        # the roots are settled in any case; then equal-cost crossings are finished before the searches end
        if tops[0] + tops[1] > best and settled[0] and len(settled[1]) >= len(ends):
            break
        side = 0 if tops[0] <= tops[1] else 1
        if not settled[1 - side]:
            side = 1 - side
        distance, node = heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side][node] = distance
        best = min(best, distance + known[1 - side].get(node, FAR))
        edges = ((w, c) for w, c, _ in _edges_on(marks, node)) if side == 0 else _edges_back(marks, node)
        for other, cost in edges:
            if distance + cost < known[side].get(other, FAR):
                known[side][other] = distance + cost
                heappush(heaps[side], (distance + cost, other))
                best = min(best, distance + cost + known[1 - side].get(other, FAR))
    return best, *settled


def _solve(marks: str) -> tuple[int, str]:
    ends = (4 * len(marks) + NONE, 4 * len(marks) + ASSISTANT)
    best, ahead, behind = _meet(marks, ends)
    # nodes of the forward search that lie on a cheapest path: from all crossings back
    good = {v for v, d in ahead.items() if d + behind.get(v, FAR) == best}
    good |= {v for v, d in ahead.items() if v not in good and any(d + c + behind.get(w, FAR) == best for w, c, _ in _edges_on(marks, v))}
    open_ = list(good)
    while open_:
        node = open_.pop()
        for before, cost in _edges_back(marks, node):
            if before not in good and ahead.get(before, FAR) + cost == ahead[node]:
                good.add(before)
                open_.append(before)
    # all cheapest paths at once, by the least letter
    letters, front = [], {0: 0}
    while not any(front.get(e) == best for e in ends):
        least, reached = "Z", {}
        for node, spent in front.items():
            for other, cost, letter in _edges_on(marks, node):
                total = spent + cost
                if letter <= least and (total + behind.get(other, FAR) == best or (other in good and ahead[other] == total)):
                    if letter < least:
                        least, reached = letter, {}
                    reached[other] = total
        letters.append(least)
        front = reached
    return best, "".join(letters)


_solve_again = lru_cache(maxsize=1 << 16)(_solve)


def cheapest_edits(marks: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair.

    ``marks`` has a letter for every turn: ``s``, ``u``, ``a`` for the role, ``o`` for any other role, upper case for a truncated turn, ``x``
    for a turn that must go. Of equally cheap repairs the one with the least audit is taken.
    """
    return _solve_again(marks) if len(marks) <= REMEMBERED else _solve(marks)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Planted faults: ``crc32("conv:turn") % 20`` loses a turn (0), empties it (1), takes its stops (2), repeats it (3) or its role becomes user (4).

    Nulls in role and text, and in the key, count as one space. A lost turn stays as a row with ``there`` false, so that its conversation is known.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(part(conv_col), F.lit(":"), part(turn_col))
    code = F.col("code")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (code != 0).alias("there"), "code")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1)))).select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "there"
    )


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None) -> DataFrame:
    """The turns under own names, with a digest of role and text that also orders turns of one number."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        blank(role_col).alias("role"),
        blank(text_col).alias("text"),
        (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def turn_faults(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``there``, ``initial`` and ``fault`` of turns as ``_rows`` gives them, and what orders them; texts stay behind."""
    narrow = rows.select("conv", "turn", "there", "role", "digest", (~F.col("text").rlike(WRITTEN)).alias("blank"), F.col("text").rlike(ENDED).alias("ended"))
    same = Window.partitionBy("conv", "there", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    again = F.row_number().over(same) > 1
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(~F.col("ended"), CUT).otherwise(0)
    initial = F.substring("role", 1, 1)
    return narrow.select("conv", "turn", "there", "role", "digest", initial.alias("initial"), fault.alias("fault"))


class _Report:
    """What one conversation's turns, read in order, add up to."""

    def __init__(self, conv):
        self.conv, self.marks, self.counts = conv, bytearray(), [0, 0, 0, 0]
        self.illegal, self.last, self.low, self.high, self.numbers = 0, None, None, None, 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.numbers += turn != self.high
            self.high = turn
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        mark = initial if initial in ("s", "u", "a") else "o"
        self.marks += (b"x" if fault in (BLANK, DUPLICATE) else (mark.upper() if fault == CUT else mark).encode())

    def row(self) -> tuple:
        cost, audit = cheapest_edits(self.marks.decode())
        gaps = self.high - self.low + 1 - self.numbers if self.numbers else 0
        return (self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, cost, audit)


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``limit`` rows, or about 8 MB of text, whichever comes first."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == limit or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _report(rows: DataFrame) -> DataFrame:
    faults = turn_faults(rows).repartition("conv")
    ordered = faults.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest", F.col("fault") == DUPLICATE).select("conv", "turn", "there", "initial", "fault")
    schema = T.StructType([rows.schema["conv"], *[T.StructField(c, T.LongType()) for c in REPORT], T.StructField("audit", T.StringType())])
    made = _arrow(schema)

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at: _Report | None = None
        for conv, turn, there, initial, fault in _tuples(batches):
            if at is None or conv != at.conv:
                if at is not None:
                    yield at.row()
                at = _Report(conv)
            if there:
                at.add(turn, initial, fault)
        if at is not None:
            yield at.row()

    ship_package(rows.sparkSession)
    return ordered.mapInArrow(lambda batches: _batches(reports(batches), made), schema)


def repair_report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None) -> DataFrame:
    """One row per conversation: its identifier, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    Turns are taken by number, those without one first; turns of one number by role and text. A null role or text is one space, a null
    conversation is one of its own. A turn's first fault counts: blank, repeated (role and text stood earlier), truncated (its last letter is no ``.!?``).
    ``gaps`` are missing numbers, ``illegal`` neighbours whose role initials are not su, ua or au. The audit has the initials of the
    cheapest edits (Keep, Rerole, Delete, Insert) that leave ``(s?(ua)+)?``, the least in ASCII of equally cheap ones. Rows for which ``there`` is
    not true only name their conversation; one without turns has zeros and an empty audit. An empty table gives an empty result.
    """
    return _report(_rows(turns, conv_col, turn_col, role_col, text_col, there)).withColumnRenamed("conv", conv_col)


def _next_role(written: int, system: bool) -> str:
    return "assistant" if (written - system) % 2 else "user"


def _applied(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple[int, str, str, str]]]]:
    """For each conversation its report row and its repaired turns: place, edit, role, text. Each must be read before the next."""
    head: list[tuple | None] = [next(rows, None)]

    def turns(audit: str, conv) -> Iterator[tuple[int, str, str, str]]:
        written, system = 0, False
        for edit in audit:
            if edit == "I":
                yield written, edit, _next_role(written, system), ""
                written += 1
                continue
            _, _, role, text, *_ = head[0]
            head[0] = next(rows, None)
            if edit == "K":
                system = system or (written == 0 and role[:1] == "s")
                yield written, edit, role, text
            elif edit == "R":
                yield written, edit, _next_role(written, system), text
            written += edit != "D"

    while head[0] is not None:
        report = head[0]
        head[0] = next(rows, None)
        yield report, turns(report[-1], report[0])


def _with_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column | None) -> DataFrame:
    """Every conversation's report, followed by its turns in order: ``conv``, ``kind``, ``role``, ``text``, the report's columns."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col, there)
    report = _report(rows).withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "digest": F.lit(None).cast("binary")})
    empty = {c: F.lit(None).cast("long") for c in REPORT} | {"audit": F.lit(None).cast("string"), "kind": F.lit(1)}
    both = report.unionByName(rows.where("there").drop("there").withColumns(empty)).repartition("conv")
    ordered = both.sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("conv", "kind", "role", "text", *REPORT, "audit")


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None) -> DataFrame:
    """The turns of the repaired conversations: identifier, ``place`` from 0, ``edit`` (K, R or I), role and text. See ``repair_report``."""
    ordered = _with_turns(turns, conv_col, turn_col, role_col, text_col, there)
    fields = [("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
    schema = T.StructType([ordered.schema["conv"], *[T.StructField(*f) for f in fields]])
    made = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((report[0], *turn) for report, repaired in _applied(_tuples(batches)) for turn in repaired)
        return _batches(rows, made)

    names = {"conv": conv_col, "role": role_col, "text": text_col}
    return ordered.mapInArrow(run, schema).withColumnsRenamed(names)


def repaired_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None) -> DataFrame:
    """The report of ``repair_report`` with ``repaired_sha256``: of the repaired turns as ``role:text`` in UTF-8, joined by newlines.

    The turns pass through the hash one after the other, so a conversation of any length takes no more memory than its audit.
    """
    ordered = _with_turns(turns, conv_col, turn_col, role_col, text_col, there)
    schema = T.StructType([ordered.schema["conv"], *[T.StructField(c, T.LongType()) for c in REPORT], *[T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]])
    made = _arrow(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for report, repaired in _applied(_tuples(batches)):
            total = hashlib.sha256()
            for place, _, role, text in repaired:
                total.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield (report[0], *report[4:], total.hexdigest())

    return ordered.mapInArrow(lambda batches: _batches(digests(batches), made), schema).withColumnRenamed("conv", conv_col)
