"""Repair of conversation structure by aligning turns to the grammar ``(s?(ua)+)?``.

The turns of a conversation are aligned to target strings of role initials: an optional
leading system turn, then user and assistant in turn. Keep costs nothing, Rerole to user or
assistant ``REROLE``, Delete ``DELETE`` (required for blank and duplicate turns), Insert an
empty turn ``INSERT``; a truncated turn that is not deleted adds ``TRUNCATED``. Every
feasible length is aligned by Wagner-Fischer, all lengths with the same last role in one
matrix, since their targets share their ends. An incumbent repair, found greedily, bounds
the cost; diagonals that no alignment within that cost can reach are left out (Ukkonen's
band). The cheapest audits are traced back, smallest letter first, and compared.

Rows are range-sorted by conversation and turn and written with a row number; ``SEGMENT``
consecutive numbers make a segment, so a conversation that holds most rows is cut like any
other. A segment is aligned for every pair of grammar states it may begin and end in (a
short conversation for the few that matter), and segments are merged ``FAN`` at a time by
the cheapest way through their states. Among ways of equal cost over the same turns no
audit is the beginning of another, so the smallest audit of the whole is made of parts
that are smallest for their states. Duplicates are found from the first row number of every
role and text, combined before the shuffle and handed to the segments, not to rows. Text
is rendered segment by segment and hashed as a stream in order.

Cases: null conversations form one, with a null id; null turns come first; a null role or
text counts as one space; a role's initial is its first character, and an empty or foreign
role can't be kept; rows that share a turn stand by role and text; a conversation that lost all
its rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty
result; texts of any length stay whole; other columns are not read. A conversation's audit is
one string in one row, and its hash is read by one task in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT, FAN = 64, 64
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
ROLES = {"s": "system", "u": "user", "a": "assistant"}
_BLANKS = " \t\n\v\f\r"
#: Marks of a turn for the alignment: sound, truncated, to be deleted.
SOUND, CUT, GONE = ".t-"


# --- alignment of one segment -----------------------------------------------------------


def _row_cost(initial: str, mark: str, wanted: str) -> int | None:
    """Cost of a turn that stands for ``wanted``, None if it can't."""
    if mark == GONE:
        return None
    if initial == wanted:
        return KEEP + (mark == CUT) * TRUNCATED
    return REROLE + (mark == CUT) * TRUNCATED if wanted in "ua" else None


def greedy(initials: str, marks: str, entry: int) -> tuple[int, int]:
    """(cost, state) of a repair that only keeps, reroles and deletes."""
    cost, state = 0, entry
    for initial, mark in zip(initials, marks):
        if mark == GONE:
            cost += DELETE
            continue
        wanted = initial if (state, initial) in NEXT else "a" if state == USER else "u"
        cost += _row_cost(initial, mark, wanted)
        state = NEXT[state, wanted]
    return cost, state


def targets(entry: int, last: str, length: int) -> list[str]:
    """The strings of ``length`` that lead from ``entry`` to the state after ``last``."""
    found = []
    for head in ("", "s") if entry == START else ("",):
        rest = length - len(head)
        body = ("ua" * rest)[:rest] if last == ("ua"[rest % 2 - 1]) else ("au" * rest)[:rest]
        state = SYSTEM if head else entry
        for c in body:
            state = NEXT.get((state, c), -1)
        if rest >= 0 and state == (USER if last == "u" else ASSISTANT):
            found.append(head + body)
    return found


class Alignment:
    """Suffix costs of turns against the ends of ``...uaua`` (or ``...uauau``) in a band."""

    def __init__(self, initials: str, marks: str, last: str, bound: int) -> None:
        self.initials, self.marks, self.last, self.bound = initials, marks, last, bound
        n = self.n = len(initials)
        self.low, self.high = -(bound // DELETE), bound // INSERT
        width = self.high - self.low + 1
        far = self.far = bound + 1
        # cell (i, d): turns from i on against the last n - i + d letters
        row = [d * INSERT if d >= 0 else far for d in range(self.low, self.high + 1)]
        self.rows = [row]
        other = {"u": "a", "a": "u"}
        for i in range(n - 1, -1, -1):
            below, row = self.rows[-1], [far] * width
            cost = {c: _row_cost(initials[i], marks[i], c) for c in "ua"}
            for at in range(width):
                length = n - i + self.low + at
                if length < 0:
                    continue
                best = below[at + 1] + DELETE if at + 1 < width else far  # the turn goes, letters stay
                if length:
                    letter = last if length % 2 else other[last]
                    if cost[letter] is not None:
                        best = min(best, below[at] + cost[letter])
                    if at:
                        best = min(best, row[at - 1] + INSERT)
                row[at] = min(best, far)
            self.rows.append(row)

    def cell(self, i: int, length: int) -> int:
        at = length - (self.n - i) - self.low
        return self.rows[self.n - i][at] if 0 <= at <= self.high - self.low else self.far

    def cost(self, target: str) -> int:
        return self._open(0, target, 0)

    def _open(self, i: int, target: str, at: int) -> int:
        """Cheapest way for turns from i on and the letters from ``at`` on (a leading s aside)."""
        if at < len(target) and target[at] == "s":
            best, gone = self.far, 0
            for j in range(i, self.n):  # turns before the one kept as system turn go
                kept = _row_cost(self.initials[j], self.marks[j], "s")
                if kept is not None:
                    best = min(best, gone + kept + self.cell(j + 1, len(target) - at - 1))
                gone += DELETE
                if gone >= best or gone > self.bound:
                    break
            return best
        return self.cell(i, len(target) - at)

    def audit(self, target: str) -> str:
        """The smallest audit among the cheapest alignments to ``target``."""
        left, i, at, steps = self.cost(target), 0, 0, []
        while i < self.n or at < len(target):
            wanted = target[at] if at < len(target) else ""
            kept = _row_cost(self.initials[i], self.marks[i], wanted) if i < self.n and wanted else None
            if i < self.n and DELETE + self._open(i + 1, target, at) == left:
                step, left, i = "D", left - DELETE, i + 1
            elif wanted in ("u", "a") and INSERT + self._open(i, target, at + 1) == left:
                step, left, at = "I", left - INSERT, at + 1
            else:
                step = "K" if self.initials[i] == wanted else "R"
                left, i, at = left - kept, i + 1, at + 1
            steps.append(step)
        return "".join(steps)


def _reach(state: int, end: int) -> int | None:
    """Letters to insert to get from one state to another, None if there is no way."""
    return {(START, USER): 1, (START, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1,
            (ASSISTANT, USER): 1}.get((state, end), 0 if state == end else None)


def ways(initials: str, marks: str, entries: tuple[int, ...] = tuple(range(4)), ends: tuple[int, ...] = tuple(range(4))) -> dict:
    """(entry, end) -> (cost, audit): the cheapest way through a segment, smallest audit first."""
    n, found = len(initials), {}
    for end in ends:
        if end in (START, SYSTEM):
            for entry in entries:
                if entry == end:  # nothing is left of the segment
                    found[entry, end] = (DELETE * n, "D" * n)
                elif (entry, end) == (START, SYSTEM):  # of it one system turn
                    kept = [(_row_cost(c, m, "s"), "D" * j + "K" + "D" * (n - 1 - j)) for j, (c, m) in enumerate(zip(initials, marks))]
                    kept = [(DELETE * (n - 1) + cost, audit) for cost, audit in kept if cost is not None]
                    if kept:
                        found[entry, end] = min(kept)
            continue
        incumbents = {}
        for entry in entries:
            tries = [(DELETE * n, entry), greedy(initials, marks, entry)]
            reached = [cost + INSERT * more for cost, state in tries if (more := _reach(state, end)) is not None]
            incumbents[entry] = min(reached)
        matrix = Alignment(initials, marks, "ua"[end - USER], max(incumbents.values()))
        whole = n - marks.count(GONE)
        for entry in entries:
            bound, best = incumbents[entry], None
            forced = DELETE * (n - whole)
            shortest = max(0, whole - (bound - forced) // DELETE)
            for length in range(shortest, whole + (bound - forced) // INSERT + 1):
                for target in targets(entry, "ua"[end - USER], length) if length else [""] * (entry == end):
                    cost = matrix.cost(target)
                    if cost <= bound:
                        bound = cost
                        way = (cost, matrix.audit(target))
                        best = way if best is None else min(best, way)
            found[entry, end] = best
    return found


def through(first: dict, second: dict) -> dict:
    """The cheapest ways through two segments, one after the other."""
    found = {}
    for (entry, middle), (cost, audit) in first.items():
        for (begin, end), (more, rest) in second.items():
            if begin == middle:
                way = (cost + more, audit + rest)
                if (entry, end) not in found or way < found[entry, end]:
                    found[entry, end] = way
    return found


def played(audit: str, initials: str, state: int) -> tuple[list[tuple[int, str]], int]:
    """What an audit leaves: (index of the turn or -1, letter) in order, and the state after it."""
    left, at = [], 0
    for step in audit:
        if step == "D":
            at += 1
            continue
        letter = initials[at] if step == "K" else "a" if state == USER else "u"
        left.append((-1 if step == "I" else at, letter))
        state = NEXT[state, letter]
        at += step != "I"
    return left, state


# --- Spark ---------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """The fault injection of the test query: by the CRC of ``conv_id:turn``, modulo 20.

    0 drops the row, 1 empties its text, 2 removes sentence ends, 3 repeats it, 4 makes it a user turn.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = turns.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), draw.alias("draw"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1)))
    return rows.filter("draw <> 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


_NODE = (
    "conv_id {id}, place long, turns long, low {turn}, high {turn}, spread long, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long, entries array<int>, ends array<int>, costs array<long>, audits array<string>")


def _segments(turns: DataFrame) -> DataFrame:
    """conv_id, segment, whole (the segment is the conversation), rows (turn, role, text, number, first) in order."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"))
    numbered = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()))
    segment = F.floor(F.col("number") / SEGMENT).cast("long")
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = numbered.groupBy("conv_id", said.alias("said")).agg(F.min("number").alias("number"))
    firsts = firsts.groupBy("conv_id", segment.alias("segment")).agg(F.collect_list("number").alias("firsts"))
    packed = numbered.groupBy("conv_id", segment.alias("segment")).agg(F.sort_array(F.collect_list(F.struct("number", "turn", "role", "text"))).alias("rows"))
    first = firsts.withColumnsRenamed({"conv_id": "c", "segment": "s"})
    joined = packed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left").drop("c", "s")
    ends = numbered.groupBy("conv_id").agg(F.min("number").alias("from"), F.max("number").alias("to"))
    short = ends.filter(F.floor(F.col("from") / SEGMENT) == F.floor(F.col("to") / SEGMENT)).select(F.col("conv_id").alias("c"), F.lit(True).alias("whole"))
    return cut_lineage(joined.join(short, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", "segment", F.coalesce("whole", F.lit(False)).alias("whole"), "rows", F.coalesce("firsts", F.array().cast("array<long>")).alias("firsts")))


def _fault(row: Column, firsts: Column) -> Column:
    """b blank, d duplicate, t truncated, or a point."""
    last = F.substring(F.rtrim(row["text"], F.lit(_BLANKS)), -1, 1)
    return F.when(last == "", "b").when(~F.array_contains(firsts, row["number"]), "d").when(last.isin(*".!?"), ".").otherwise("t")


def _marked(segments: DataFrame) -> DataFrame:
    """Without texts: initials (one letter a turn, ``?`` for roles that can't be kept), faults, and the figures of a segment."""
    initial = F.transform("rows", lambda r: F.substring(r["role"], 1, 1))
    known = F.transform("rows", lambda r: F.when(F.substring(r["role"], 1, 1).isin(*ROLES), F.substring(r["role"], 1, 1)).otherwise("?"))
    turns = F.array_compact(F.transform("rows", lambda r: r["turn"]))
    return segments.select(
        "conv_id", "segment", "whole", F.array_join(known, "").alias("initials"), initial.alias("letters"),
        F.array_join(F.transform("rows", lambda r: _fault(r, F.col("firsts"))), "").alias("faults"),
        F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(F.array_distinct(turns)).cast("long").alias("spread"))


def _align(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    seen: dict = {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            faults, letters = row["faults"], row["letters"]
            marks = faults.translate(str.maketrans("bdt.", GONE + GONE + CUT + SOUND))
            shape = (row["initials"], marks, row["whole"])
            if shape not in seen:
                if len(seen) >= 10_000:
                    seen.clear()
                seen[shape] = ways(row["initials"], marks, (START,), ENDS) if row["whole"] else ways(row["initials"], marks)
            found = sorted(seen[shape].items())
            out.append({
                "conv_id": row["conv_id"], "place": row["segment"], "turns": len(letters), "low": row["low"], "high": row["high"],
                "spread": row["spread"], "first": letters[0], "last": letters[-1],
                "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
                "entries": [k[0] for k, _ in found], "ends": [k[1] for k, _ in found],
                "costs": [v[0] for _, v in found], "audits": [v[1] for _, v in found]})
        yield pa.RecordBatch.from_pylist(out, schema)


def _ways_of(node: dict) -> dict:
    return {(e, x): (c, a) for e, x, c, a in zip(node["entries"], node["ends"], node["costs"], node["audits"])}


def _merge(nodes: list[dict]) -> dict:
    nodes = sorted(nodes, key=lambda node: node["place"])
    whole = dict(nodes[0])
    found = _ways_of(whole)
    for node in nodes[1:]:
        found = through(found, _ways_of(node))
        whole["illegal"] += node["illegal"] + (whole["last"] + node["first"] not in ("su", "ua", "au"))
        whole["spread"] += node["spread"] - (node["low"] is not None and node["low"] == whole["high"])
        for name in ("turns", "blank", "duplicate", "truncated"):
            whole[name] += node[name]
        whole["last"] = node["last"]
        if node["low"] is not None:
            whole["low"] = node["low"] if whole["low"] is None else whole["low"]
            whole["high"] = node["high"]
    found = sorted(found.items())
    whole |= {"entries": [k[0] for k, _ in found], "ends": [k[1] for k, _ in found], "costs": [v[0] for _, v in found], "audits": [v[1] for _, v in found]}
    return whole


def _arrow(nodes: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(nodes.schema)


def _merged(nodes: DataFrame, parts: int) -> DataFrame:
    """One row per conversation: nodes merged ``FAN`` at a time, ``parts`` being above all places."""
    schema = _arrow(nodes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_merge(row["nodes"]) for row in batch.to_pylist()], schema)

    while parts > 1:
        parts = -(-parts // FAN)
        group = nodes.groupBy("conv_id", F.floor(F.col("place") / FAN).alias("up")).agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes"))
        lone = group.filter(F.size("nodes") == 1).select(F.inline("nodes"))
        many = group.filter(F.size("nodes") > 1).select("nodes").mapInArrow(merge, nodes.schema)
        nodes = cut_lineage(lone.unionAll(many).withColumn("place", F.floor(F.col("place") / FAN).cast("long")))
    return nodes


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, segments) after repair of ``turns`` (conv_id, turn, role, text).

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Segments: conv_id, segment, repaired (``role:text`` lines of kept, reroled and inserted turns; null if none is left).
    """
    segments = _segments(turns.select("conv_id", "turn", "role", "text"))
    marked = _marked(segments)
    per_part = (1 << 33) // SEGMENT
    size = segments.agg(F.max(F.pmod("segment", F.lit(per_part))).alias("inner"), F.max(F.floor(F.col("segment") / per_part)).alias("part")).first()
    inner, parts = (size["inner"] or 0) + 1, (size["part"] or 0) + 1
    types = {f.name: f.dataType.simpleString() for f in segments.select("conv_id", F.col("rows")[0]["turn"].alias("turn")).schema}
    schema = _NODE.format(id=types["conv_id"], turn=types["turn"])
    arrow = _arrow(segments.sparkSession.createDataFrame([], schema))
    nodes = cut_lineage(marked.mapInArrow(lambda batches: _align(batches, arrow), schema).withColumn(
        "place", (F.floor(F.col("place") / per_part) * inner + F.pmod("place", F.lit(per_part))).cast("long")))
    whole = _merged(nodes, inner * parts)
    best = F.array_min(F.filter(
        F.zip_with(F.arrays_zip("entries", "ends"), F.arrays_zip("costs", "audits"), lambda k, v: F.when(
            (k["entries"] == START) & k["ends"].isin(*ENDS), F.struct(v["costs"].alias("cost"), v["audits"].alias("audit")))),
        lambda v: v.isNotNull()))
    gaps = F.coalesce(F.col("high").cast("long") - F.col("low") + 1 - F.col("spread"), F.lit(0)).cast("long")
    conversations = cut_lineage(whole.select(
        "conv_id", "turns", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("best")).select("*", "best.cost", "best.audit").drop("best"))
    return conversations.drop("turns"), _rendered(segments, marked, conversations)


def _rendered(segments: DataFrame, marked: DataFrame, conversations: DataFrame) -> DataFrame:
    """The audit of a conversation is cut where its segments begin; each piece knows its state."""
    letters = marked.select("conv_id", "segment", "initials")
    own = letters.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "initials"))).alias("parts"))
    held = own.withColumnRenamed("conv_id", "c").join(conversations.select("conv_id", "audit"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    fields = "segment long, kept array<struct<at:int,role:string>>"
    schema = f"{held.select('conv_id').schema.fields[0].name} {held.schema['conv_id'].dataType.simpleString()}, {fields}"
    arrow = _arrow(segments.sparkSession.createDataFrame([], schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, at, audit = START, 0, row["audit"]
                for number, part in enumerate(row["parts"]):
                    end, rows = at, 0
                    last = number == len(row["parts"]) - 1
                    while end < len(audit) and (last or rows < len(part["initials"])):
                        rows += audit[end] != "I"
                        end += 1
                    left, state = played(audit[at:end], part["initials"], state)
                    at = end
                    out.append({"conv_id": row["conv_id"], "segment": part["segment"], "kept": [
                        {"at": index, "role": None if index >= 0 and part["initials"][index] == letter else ROLES[letter]} for index, letter in left]})
            yield pa.RecordBatch.from_pylist(out, arrow)

    pieces = held.mapInArrow(cut, schema).withColumnsRenamed({"conv_id": "c", "segment": "s"})
    joined = segments.select("conv_id", "segment", "rows").join(pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    row = lambda k: F.get("rows", k["at"])
    lines = F.transform("kept", lambda k: F.concat(
        F.coalesce(k["role"], row(k)["role"]), F.lit(":"), F.coalesce(row(k)["text"], F.lit(""))))
    return joined.select("conv_id", "segment", F.when(F.size("kept") > 0, F.array_join(lines, "\n")).alias("repaired"))


def repaired_hashes(segments: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the segments of a conversation, joined by newlines, hashed as a stream."""
    schema = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    arrow = _arrow(segments.sparkSession.createDataFrame([], schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        current, running, first = nothing, None, True

        def done():
            return pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": running.hexdigest()}], arrow)

        for batch in batches:
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("repaired")):
                if current is nothing or conv != current:
                    if current is not nothing:
                        yield done()
                    current, running, first = conv, hashlib.sha256(), True
                if text.is_valid:
                    running.update((b"" if first else b"\n") + text.as_py().encode())
                    first = False
        if current is not nothing:
            yield done()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(stream, schema)
