"""Conversations: seeded damage, and the cheapest edits that make their structure sound again."""

from __future__ import annotations

import tempfile
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pactframe.llm.common import SLICE_ROWS, release, slices, small_batches

#: Costs of edits, and of an undeleted truncated row.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")
#: What a sequence of roles may end with so far: nothing, a system row, a user's, an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role that comes next after each, and where that leads.
_NEXT = ("user", "user", "assistant", "user")
_AFTER = (USER, USER, ASSISTANT, USER)
#: Bytes of backpointers that a task holds in memory before it writes them to a file of its own; four bytes a row.
HELD_BYTES = 1 << 20


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy of `conversations` rows after damage; `copy` is null for rows that are dropped.

    What happens to a row depends on crc32 of `conv_id:turn`, modulo 20: 0
    drops it, 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes its
    role user.  A null is one space, in that key too.  Dropped rows stay as
    marks, so that a conversation that loses all rows is still known.
    """
    space = F.lit(" ")
    draw = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    out = rows.select("conv_id", "turn", draw.alias("_draw"), F.when(draw == 4, "user").otherwise(role).alias("role"),
                      F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("_draw") > 0, F.lit(0))))
    return out.withColumn("copy", F.explode(copies)).drop("_draw")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds fault, the place in FAULTS of a row's first one, to rows (conv_id, turn, role, text, copy), and deals conversations to tasks.

    A row is a duplicate if an earlier one of its conversation has its role
    and text.  Both this and the pass after it work on one exchange, by
    conversation: rows are sorted within it, and Spark spills what is long.
    """
    own = rows.repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("copy").isNull(), F.col("turn").asc_nulls_first(), "copy")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", 1).when(F.row_number().over(earlier) > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return own.withColumn("fault", fault)


class Repair:
    """The edits of one conversation, row by row: cheapest, and of these the least in letters.

    For each end of the sequence the state has the cost of the best edits so
    far, their rank among all ends by letters, and the running hash of the
    repaired lines.  Best edits of two ends never begin one another (both
    have passed the same rows, and end with a row's edit), so ranks decide
    ties for good.  A row leaves four bytes, one an end: where its best edits
    came from, whether a row was inserted before, and the edit.  A role
    without a first character fits nowhere as it is.
    """

    def __init__(self):
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.lines = [sha256(), None, None, None]
        self.back = bytearray()
        self.file = None
        self.rows = 0

    def add(self, role: str, text: str, fault: int) -> None:
        stays, extra, initial = fault not in (1, 2), TRUNCATED if fault == 3 else 0, role[:1]
        best: list[tuple | None] = [None] * 4
        for at, cost in enumerate(self.cost):
            if cost is None:
                continue
            rank = self.rank[at]
            # Never two inserted rows in one place: deleting a row, or none, is cheaper (tests compare with all edits).
            for end, paid, letters, back in ((at, cost, "", at), (_AFTER[at], cost + INSERT, "I", at | 4)):
                ways = [(paid + DELETE, rank, letters + "D", end, back)]
                if stays:
                    ways.append((paid + RENAME + extra, rank, letters + "R", _AFTER[end], back | 16))
                    if initial == _NEXT[end][0]:
                        ways.append((paid + extra, rank, letters + "K", _AFTER[end], back | 8))
                    elif initial == "s" and end == NONE:
                        ways.append((paid + extra, rank, letters + "K", SYSTEM, back | 8))
                for way in ways:
                    if best[way[3]] is None or way[:3] < best[way[3]][:3]:
                        best[way[3]] = way
        found = [b for b in best if b is not None]
        order = {b[1:3]: k for k, b in enumerate(sorted(found, key=lambda b: b[1:3]))}
        lines = []
        for b in best:
            lines.append(None if b is None else self._line(b[4], role, text))
        self.back += bytes([0 if b is None else b[4] for b in best])
        self.cost = [None if b is None else b[0] for b in best]
        self.rank = [0 if b is None else order[b[1:3]] for b in best]
        self.lines = lines
        self.rows += 1
        if len(self.back) >= HELD_BYTES:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # has no name, so nothing stays of it
            self.file.write(self.back)
            self.back = bytearray()

    def _line(self, back: int, role: str, text: str):
        at = back & 3
        lines = self.lines[at]
        if back & 4:
            lines, at = self._with(lines, at, _NEXT[at], ""), _AFTER[at]
        if back & 8:
            return self._with(lines, at, role, text)
        return self._with(lines, at, _NEXT[at], text) if back & 16 else lines

    @staticmethod
    def _with(lines, at: int, role: str, text: str):
        lines = lines.copy()
        lines.update(f"{'' if at == NONE else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        return lines

    def result(self) -> tuple[int, str, str]:
        """(cost, letters of the edits in order, SHA-256 of the repaired lines)."""
        ends = []
        for at, cost in enumerate(self.cost):
            if cost is not None:
                for end, paid, inserted in ((at, cost, 0), (_AFTER[at], cost + INSERT, 1)):
                    if end in (NONE, ASSISTANT):
                        ends.append((paid, self.rank[at], inserted, at))
        cost, _, inserted, at = min(ends)
        lines = self._with(self.lines[at], at, _NEXT[at], "") if inserted else self.lines[at]
        letters = ["I"] if inserted else []
        for back in self._backwards():
            b = back[at]
            letters.append("K" if b & 8 else "R" if b & 16 else "D")
            if b & 4:
                letters.append("I")
            at = b & 3
        if self.file is not None:
            self.file.close()
        return cost, "".join(reversed(letters)), lines.hexdigest()

    def _backwards(self):
        held = bytes(self.back)
        left = 4 * self.rows - len(held)
        while True:
            for k in range(len(held) - 4, -1, -4):
                yield held[k:k + 4]
            if not left:
                return
            size = min(left, HELD_BYTES)
            left -= size
            self.file.seek(left)
            held = self.file.read(size)


_LEGAL = {"su", "ua", "au"}
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """Counts and edits of the conversation that a task is at."""

    def __init__(self):
        self.repair = Repair()
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.before = None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults[1:], self.illegal, *self.repair.result())


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation in `damaged` rows.

    One exchange by conversation; in it rows are sorted by turn (nulls first,
    then role, text and copy, which orders ties;
    the first of repeated rows is no duplicate) and streamed:
    the state of the edits goes on across Arrow batches, so a task holds a
    batch, a running hash for each end of the sequence and four bytes a row,
    those beyond HELD_BYTES in a file of the task.  A conversation is never
    split, as its hash runs over all its lines in order.  A null conv_id is a
    conversation of its own; texts may be of any length; an empty table gives
    no row; other columns are not read.
    """
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(_RESULT).fields])
    sorted_rows = (with_faults(rows.select("conv_id", "turn", "role", "text", "copy"))
                   .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy", F.col("fault") == 2))

    def over(batches):
        at, now, done, types = None, None, [], None

        def made():
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for part in slices(batch):
                for conv, turn, role, text, copy, fault in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if now is None or conv != at:
                        if now is not None:
                            done.append((at, *now.row()))
                        at, now = conv, _Conversation()
                    if copy is not None:
                        now.add(turn, role, text, fault)
                if len(done) >= SLICE_ROWS:
                    yield made()
        if now is not None:
            done.append((at, *now.row()))
        if done:
            yield made()
        release()

    small_batches(rows.sparkSession)
    return sorted_rows.select("conv_id", "turn", "role", "text", "copy", "fault").mapInArrow(over, schema)


def _sql() -> str:
    """The operator in SQL: states of the edits are structs (cost, letters, lines) by the end of the sequence, a row a step."""
    ins = lambda s, role: f"{{'c': {s}.c + {INSERT}, 'a': {s}.a || 'I', 'b': {s}.b || {line(s, repr(role), repr(''))}}}"
    line = lambda s, role, text: f"case when {s}.b = '' then '' else chr(10) end || {role} || ':' || {text}"
    none = f"{{'c': {10**12}::bigint, 'a': '', 'b': ''}}"
    drop = lambda e: f"{{'c': {e}.c + {DELETE}, 'a': {e}.a || 'D', 'b': {e}.b}}"
    name = lambda e, role: f"case when fault in (1, 2) then {none} else {{'c': {e}.c + {RENAME} + extra, 'a': {e}.a || 'R', 'b': {e}.b || {line(e, repr(role), 'text')}}} end"
    keep = lambda e, initial: f"case when fault in (1, 2) or role[1] <> '{initial}' then {none} else {{'c': {e}.c + extra, 'a': {e}.a || 'K', 'b': {e}.b || {line(e, 'role', 'text')}}} end"
    users = ", ".join(f"{name(e, 'user')}, {keep(e, 'u')}" for e in ("e0", "e1", "e3"))
    return rf"""
with recursive crc as (
  select list(c order by n) as t from (
    select n, list_reduce(list_concat([n::bigint], list_transform(range(8), lambda x: x::bigint)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(n))
), drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), damage as (
  select conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::bigint)),
    lambda a, b: xor(a >> 8, t[(1 + (xor(a, b) & 255))::int])), 4294967295) % 20 as draw from drawn, crc
), changed as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role, case draw when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case draw when 0 then []::int[] when 3 then [0, 1] else [0] end) as copy from damage
), numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from changed
), faults as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end as fault from numbered
), rows_ as (select *, case when fault = 3 then {TRUNCATED} else 0 end as extra, lag(role[1]) over (partition by conv_id order by i) || role[1] as two from faults
), all_ids as (select distinct conv_id from conversations
), states as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': '', 'b': ''}} as s0, {none} as s1, {none} as s2, {none} as s3 from all_ids
  union all
  select conv_id, i, {drop('e0')} as s0, list_min([{drop('e1')}, {keep('e0', 's')}]) as s1, list_min([{drop('e2')}, {users}]) as s2, list_min([{drop('e3')}, {name('e2', 'assistant')}, {keep('e2', 'a')}]) as s3
  from (select r.*, s0 as e0, s1 as e1, list_min([s2, {ins('s0', 'user')}, {ins('s1', 'user')}, {ins('s3', 'user')}]) as e2, list_min([s3, {ins('s2', 'assistant')}]) as e3
        from states s join rows_ r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1)
), ends as (
  select conv_id, list_min([s0, s3, {ins('s2', 'assistant')}]) as best from (select *, row_number() over (partition by conv_id order by i desc) as k from states) where k = 1
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
    count(*) filter (fault = 3) as truncated, count(*) filter (two not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id
)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  best.c as cost, best.a as audit, sha256(best.b) as repaired_sha256
from ends e left join counts c on c.conv_id is not distinct from e.conv_id
"""


REPAIR_SQL = _sql()
