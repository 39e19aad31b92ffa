"""Repair of conversation structure by the cheapest edits.

A conversation is right if the first letters of its roles give `(s?(ua)+)?`. Going through its
rows, each is kept, given another role or deleted, and empty turns can be inserted
anywhere, at the costs below. Blank rows and rows whose role and text came before must
go; a truncated text costs more if it stays.

For each conversation a stream in reverse order finds what it costs to reach the end, for
each row and state of the grammar. A second stream in order walks forward from the start and takes, of the
edits that keep to that cost, the one whose letter is least; as a state and a letter fix the next state,
the letters together are the least of all cheapest edits. The turns are rebuilt on the way, and a third stream
digests them. Rows are shuffled once, by conversation; a task holds one turn
at a time, however long a conversation is, and what is sorted can spill. One conversation is one
task's work, for its digest is made in order.

Rows go by turn (null first), then role and text. Null roles and texts are one space, and so blank. Rows of a null conv_id
are one conversation. A conversation without rows is right as it is, and an empty table
has none. Repeated rows are duplicates of the first. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import WHITE, shuffle_partitions, slices, text_hashes

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated row costs beside its edit, if it stays.
TRUNCATED_STAYS = 5
#: A row's first fault.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

#: States of the grammar: at the start, after the system's turn, the user's and the assistant's. Where a turn with some first letter leads, and which states may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
#: The turn that each state asks for, if one is inserted or given another role.
ASKED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: Neighbours that the grammar has.
LEGAL = frozenset(("su", "ua", "au"))

_NEVER = 1 << 60
Costs = tuple[int, int, int, int]


def _with_inserts(costs: list[int]) -> Costs:
    """`costs` of each state, or of an insert and the state after it, if that is cheaper."""
    after = lambda s: NEXT[s, ASKED[s][0]]  # noqa: E731
    for state in (ASSISTANT, USER, ASSISTANT, START, SYSTEM):
        costs[state] = min(costs[state], COST[INSERT] + costs[after(state)])
    return tuple(costs)


AT_END = _with_inserts([0 if s in ENDS else _NEVER for s in range(4)])


def _stays(fault: str | None, initial: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits by which a row stays."""
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_STAYS if fault == TRUNCATED else 0
    if (state, initial) in NEXT:
        yield KEEP, COST[KEEP] + more, NEXT[state, initial]
    yield REROLE, COST[REROLE] + more, NEXT[state, ASKED[state][0]]


@lru_cache(1 << 16)
def _before(fault: str | None, initial: str, after: Costs) -> Costs:
    """Costs from before a row, by those from after it, which are counted from 0."""
    return _with_inserts([min(COST[DELETE] + after[s], *(c + after[to] for _, c, to in _stays(fault, initial, s)), _NEVER) for s in range(4)])


def _lowered(costs: Costs) -> tuple[Costs, int]:
    """Costs less their least, which differ by a few units at most; and the least."""
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(1 << 16)
def _walked(fault: str | None, initial: str, after: Costs, state: int) -> tuple[tuple[tuple[str, int, int], ...], int]:
    """The least tight edits (edit, cost, next state) at a row, inserts before it included, and the state after it."""
    edits, here = [], _before(fault, initial, after)
    while True:
        inserted = NEXT[state, ASKED[state][0]]
        ways = [(DELETE, COST[DELETE], state, COST[DELETE] + after[state]), (INSERT, COST[INSERT], inserted, COST[INSERT] + here[inserted])]
        ways += [(edit, c, to, c + after[to]) for edit, c, to in _stays(fault, initial, state)]
        edit, cost, to, _ = min(w for w in ways if w[3] == here[state])
        edits.append((edit, cost, to))
        state = to
        if edit != INSERT:
            return tuple(edits), state


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with faults planted by crc32 of `conv_id:turn` mod 20.

    0 drops a row (it stays as one that is gone, so that its conversation is known),
    1 empties its text, 2 takes its full stops and marks away, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(times)).drop("col")


def edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of (conv_id, turn, role, text), in order within partitions.

    A row has conv_id, place, edit, cost, the role and text that stay (null if none do), and turn, initial and
    fault of the row that was edited. If `turns` has a column `gone`, rows for which it is true
    stand for their conversation only; each of them gives a row without an edit.
    """
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), gone.alias("gone"))
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id")
    a, b = text_hashes(F.col("text"))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    # The shuffle by conversation serves this window too.
    same = Window.partitionBy("conv_id", "gone", "role", "a", "b").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumns({"a": a, "b": b}).withColumn("again", F.row_number().over(same) > 1).drop("a", "b")
    fault = F.when(end == "", BLANK).when(F.col("again"), DUPLICATE).when(~end.isin(*".!?"), TRUNCATED)
    rows = rows.select("conv_id", "turn", "role", "text", "gone", "again", fault.alias("fault"), F.left("role", F.lit(1)).alias("initial"))

    def backward(batches):
        """With each row its number from the end, and what the end costs from each state after it."""
        last, number, after = None, 0, AT_END
        for batch in slices(batches):
            numbers, costs = [], []
            for conv, is_gone, fault, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "fault", "initial")), strict=True):
                if last != (conv,):
                    last, number, after = (conv,), 0, AT_END
                number += 1
                numbers.append(number)
                costs.append(after)
                if not is_gone:
                    after = _lowered(_before(fault, initial, after))[0]
            added = [pa.array(numbers, pa.int64()), pa.array(costs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "number", "after"])

    def forward(batches):
        last, state, place = None, START, 0
        for batch in slices(batches):
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault", "initial", "number", "after"))
            for conv, turn, role, text, is_gone, fault, initial, number, after in zip(*columns, strict=True):
                if last != (conv,):
                    last, state, place = (conv,), START, 0
                found: tuple = ()
                if is_gone:
                    out.append((conv, None, None, None, None, None, None, None, None))
                else:
                    found, to = _walked(fault, initial, tuple(after), state)
                for edit, cost, _ in found:
                    stays = {KEEP: (role, text), REROLE: (ASKED[state], text), INSERT: (ASKED[state], ""), DELETE: (None, None)}[edit]
                    out.append((conv, place, edit, cost, *stays, *((None, None, None) if edit == INSERT else (turn, initial, fault))))
                    state, place = (NEXT[state, ASKED[state][0]] if edit == INSERT else to), place + 1
                if number == 1:
                    # After the last row: what is missing at the end.
                    while state not in ENDS:
                        out.append((conv, place, INSERT, COST[INSERT], ASKED[state], "", None, None, None))
                        state, place = NEXT[state, ASKED[state][0]], place + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 9, kinds, strict=True)], names)

    schema = "conv_id long, place long, edit string, cost long, role string, text string, turn long, initial string, fault string"
    names, kinds = [c.split()[0] for c in schema.split(", ")], [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    # Rows that are gone come first, so that the last of a conversation is one that is there, if any is.
    reverse = rows.sortWithinPartitions("conv_id", "gone", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("again")).drop("again")
    costed = reverse.mapInArrow(backward, T.StructType([*reverse.schema, T.StructField("number", T.LongType()), T.StructField("after", T.ArrayType(T.LongType()))]))
    return costed.sortWithinPartitions("conv_id", F.desc("number")).mapInArrow(forward, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the turns that stay, have another role, or are inserted."""
    return edits(turns).where("role is not null").select("conv_id", "place", "role", "text")


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """What is told of one conversation, edit by edit."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.illegal, self.cost = conv, {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}, 0, 0
        self.first = self.turn = self.initial = None
        self.distinct, self.audit, self.digest, self.started = 0, [], sha256(), False

    def add(self, edit, cost, role, text, turn, initial, fault) -> None:
        self.audit.append(edit)
        self.cost += cost
        if role is not None:
            self.digest.update(f"{'\n' if self.started else ''}{role}:{text}".encode())
            self.started = True
        if edit == INSERT:
            return
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            # Turns come in order.
            self.distinct += turn != self.turn
            self.first, self.turn = turn if self.first is None else self.first, turn
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.initial = initial

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.distinct
        return self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def repair_digests(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation."""

    def digest(batches):
        now, out = None, []
        for batch in slices(batches):
            for conv, edit, *told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "role", "text", "turn", "initial", "fault")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv)
                if edit is not None:
                    now.add(edit, *told)
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _REPORT.split(", ")])

    # The edits arrive in the order in which the partition was sorted.
    return edits(turns).mapInArrow(digest, _REPORT)


_N, _BITS = 1_000_000_000, "[0, 0, 0, 0, 0, 0, 0, 0]"


def _stays_sql(kept: str, reroled: str) -> str:
    return f"case when fault in ('b', 'd') then {_N} else more + least({kept}, 1 + {reroled}) end"


#: The same recursions in SQL, row by row; crc32 is made bit by bit.
ORACLE_SQL = rf"""
with recursive bits as (
  select list(v order by i) as t from (select i, list_reduce(list_concat([i], {_BITS}), lambda c, k: case when c & 1 = 1 then xor(c >> 1, {0xEDB88320}) else c >> 1 end) as v from range(256) r(i))
), base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor({0xFFFFFFFF}, list_reduce(list_concat([{0xFFFFFFFF}], list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as f
  from conversations, bits
), damaged as (
  select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from base, range(2) r(i) where f <> 0 and (i = 0 or f = 3)
), told as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again, left(role, 1) as c0, regexp_replace(text, '[ 	-]+$', '') as body from damaged
), placed as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n, lag(c0) over w as before from told window w as (partition by conv_id order by turn nulls first, role, text, again)
), judged as (
  select *, case when body = '' then 'b' when again then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault from placed
), rows_ as (
  select conv_id, i, n, role, text, c0, fault, case when fault = 't' then {TRUNCATED_STAYS} else 0 end as more from judged
), back(conv_id, i, a0, a1, a2, a3) as (
  select conv_id, n + 1, 0, 10, 5, 0 from rows_ where i = 1
  union all
  select conv_id, i, least(v0, 5 + least(v2, 5 + v3)), least(v1, 5 + least(v2, 5 + v3)), least(v2, 5 + v3), least(v3, 5 + v2) from (
    select r.conv_id, r.i, least(2 + a0, {_stays_sql(f"case c0 when 's' then a1 when 'u' then a2 else {_N} end", "a2")}) as v0, least(2 + a1, {_stays_sql(f"case c0 when 'u' then a2 else {_N} end", "a2")}) as v1,
      least(2 + a2, {_stays_sql(f"case c0 when 'a' then a3 else {_N} end", "a3")}) as v2, least(2 + a3, {_stays_sql(f"case c0 when 'u' then a2 else {_N} end", "a2")}) as v3
    from back b join rows_ r on r.conv_id = b.conv_id and r.i = b.i - 1)
), costs as (
  select conv_id, i, [a0, a1, a2, a3] as a from back
), walk(conv_id, i, s, audit, turns, cost) as (
  select conv_id, cast(1 as bigint), 0, '', '', 0 from rows_ where i = 1
  union all
  select conv_id, i + case when e = 'I' then 0 else 1 end, case e when 'D' then s when 'K' then kept else asked end, audit || e,
    turns || case e when 'D' then '' when 'K' then chr(10) || role || ':' || text when 'R' then chr(10) || asked_role || ':' || text else chr(10) || asked_role || ':' end,
    cost + case e when 'D' then 2 when 'I' then 5 when 'K' then more else 1 + more end
  from (
    select *, case when role is not null and here = 2 + after[s + 1] then 'D' when here = 5 + a[asked + 1] then 'I' when fault not in ('b', 'd') and here = more + after[kept + 1] then 'K' else 'R' end as e
    from (
      select w.*, h.a, h.a[w.s + 1] as here, x.a as after, r.role, r.text, r.fault, r.more, case when w.s = 2 then 3 else 2 end as asked, case when w.s = 2 then 'assistant' else 'user' end as asked_role,
        case when w.s = 0 and c0 = 's' then 1 when w.s <> 2 and c0 = 'u' then 2 when w.s = 2 and c0 = 'a' then 3 end as kept
      from walk w join costs h on h.conv_id = w.conv_id and h.i = w.i left join costs x on x.conv_id = w.conv_id and x.i = w.i + 1 left join rows_ r on r.conv_id = w.conv_id and r.i = w.i
      where r.i is not null or w.s not in (0, 3)))
), ended as (
  select conv_id, arg_max(audit, length(audit)) as audit, arg_max(turns, length(audit)) as turns, arg_max(cost, length(audit)) as cost from walk group by conv_id
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (before is not null and before || c0 not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit,
  sha256(coalesce(substr(turns, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counted on c.conv_id = counted.conv_id left join ended on c.conv_id = ended.conv_id
"""
