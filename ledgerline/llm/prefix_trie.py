"""Trie of conversations' prefixes, with subtree totals by messages from leaves to the root.

Every distinct sequence of first turns is a node. A stream over each conversation's
turns chains hashes (of the prefix before, and of the turn's role and text), so that a node is a key of 128
bits and the trie is an aggregate by key: its members, their least id, its last turn's bytes.

Nodes with one member need no messages: there is one leaf below, and nothing is saved. Of the
others, a run of nodes that have one such child each is one unit. Units hold how many child units they still
wait for; in each round those that wait for none send their totals to their parent and are
finished, until only the root's is left. Rounds are as many as there are branchings one below the other, however
deep the trie is.

Rows of a null conv_id belong to no conversation and take no part. Turns go by turn (null first), then role, the text's first 64
characters and its hash. Null roles and texts are empty, repeated rows are turns of their own, and an
empty table has no nodes, not even a root. Extra columns are not read. Only hashes of texts are shuffled. One conversation's
turns are hashed in order by one task, which holds one of them; so are the ids of those that end in one node, for their digest.
"""

from __future__ import annotations

import struct
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed, shuffle_partitions, slices

#: Conversations of one group of so many ids share turns with the group's first; of so many turns less one at most.
GROUP, MOST_SHARED = 5, 9
#: A parent with more than this part of all nodes is a hub; there are fewer than `HUBS`.
HUBS = 1024
#: Characters of a text that order turns which are alike otherwise.
_TIE = 64
_EMPTY = sha256(b"").hexdigest()
_MEMBER = "conv_id long, depth long, a long, b long, parent_a long, parent_b long, bytes long, ends boolean"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x, y, bytes): each turn's place in its conversation, from 1, hashes of role and text, and the text's bytes."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty("role"), empty("text")
    hashes = [F.xxhash64(F.lit(i), F.octet_length(role), role, text).alias(c) for i, c in enumerate("xy")]
    rows = conversations.where(F.col("conv_id").cast("long").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.left(text, F.lit(_TIE)).alias("start"), *hashes, F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "start", "x", "y")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "x", "y", "bytes")


def with_shared_turns(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt as (conv_id, part, pos, x, y, bytes): the first h turns of c - c % 5, then c's own after its first h; h is crc32(c) % 9.

    Part 0 is a row without a turn for each conversation, part 1 are the turns of another, part 2 its own.
    """
    turns = checkpointed(turns)
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    ids = turns.where("pos = 1").select("conv_id", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("donor"))
    none = F.lit(None).cast("long")
    begun = ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), none.alias("x"), none.alias("y"), none.alias("bytes"))
    # A conversation gives at most 8 turns to at most 9 others.
    given = turns.where(F.col("pos") < MOST_SHARED).withColumnRenamed("conv_id", "donor").join(ids, "donor").where(F.col("pos") <= F.col("h"))
    own = turns.where(F.col("pos") > shared)
    return begun.union(given.select("conv_id", F.lit(1), "pos", "x", "y", "bytes")).union(own.select("conv_id", F.lit(2), "pos", "x", "y", "bytes"))


def members(rebuilt: DataFrame) -> DataFrame:
    """The nodes that each conversation of (conv_id, part, pos, x, y, bytes) is a member of, the root (0, 0) included."""
    names = [c.split()[0] for c in _MEMBER.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.bool_()]

    def chain(batches):
        last = None  # of the row before: known to be the conversation's last when another begins
        for batch in slices(batches):
            out = []
            for conv, x, y, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "x", "y", "bytes")), strict=True):
                begins = last is None or last[0] != conv
                if last is not None:
                    out.append((*last, begins))
                if begins:
                    last = (conv, 0, 0, 0, None, None, 0)
                else:
                    _, depth, a, b, *_ = last
                    last = (conv, depth + 1, *struct.unpack("<2q", blake2b(struct.pack("<4q", a, b, x, y), digest_size=16).digest()), a, b, size)
            yield batch_of(out)
        if last is not None:
            yield batch_of([(*last, True)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names)

    # Part 0 begins each conversation: the rows of one are together and in order.
    ordered = rebuilt.repartition(shuffle_partitions(rebuilt.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return ordered.mapInArrow(chain, _MEMBER)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): of each node, the ids that end in it, ascending, as one digest."""

    def digest(batches):
        node, state, out = None, None, []
        for batch in slices(batches):
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id")), strict=True):
                if node != (a, b):
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield batch_of(out)
            out = []
        if node is not None:
            yield batch_of([(*node, state.hexdigest())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)], ["a", "b", "ends_sha256"])

    ordered = ends.select("a", "b", "conv_id").repartition(shuffle_partitions(ends.sparkSession), "a", "b").sortWithinPartitions("a", "b", "conv_id")
    return ordered.mapInArrow(digest, "a long, b long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """`nodes` with their parent's conv_id, n_convs and n_shared (null: the root). Parents of very many are broadcast, fewer than `HUBS` rows; the others are joined."""
    total = nodes.count()
    columns = [F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"), F.col("n_shared").alias("parent_shared")]
    parents = nodes.where("n_children > 0").select(*columns, (F.col("n_children") * HUBS > total).alias("hub"))
    told = [F.col(c).alias(f"_{c}") for c in ("parent_conv_id", "parent_convs", "parent_shared")]
    hubs = parents.where("hub").select("parent_a", "parent_b", F.struct(*told).alias("of_hub"))
    marked = nodes.join(F.broadcast(hubs), ["parent_a", "parent_b"], "left")
    names = [*nodes.columns, "parent_conv_id", "parent_convs", "parent_shared"]
    near = marked.where("of_hub is not null or depth = 0").select(*nodes.columns, *[F.col(f"of_hub._{c}").alias(c) for c in names[-3:]])
    others = marked.where("of_hub is null and depth > 0").drop("of_hub").join(parents.where("not hub").drop("hub"), ["parent_a", "parent_b"])
    return near.unionByName(others.select(*names))


def _units(nodes: DataFrame) -> DataFrame:
    """Nodes with two members or more, with their unit (conv_id, unit_depth), where the unit hangs (a parent's key), and sums from a node to its unit's end.

    Such nodes of one conv_id are a path; a unit ends where a node of it has not just one child with
    members to share. Leaves that hang below private children count in their parent.
    """
    shared = nodes.where("n_convs > 1")
    path = Window.partitionBy("conv_id").orderBy("depth")
    begins = F.coalesce(F.lag("n_shared").over(path) != 1, F.lit(True))
    unit = F.last(F.when(begins, F.col("depth")), ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, 0))
    own = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_children") - F.col("n_shared"))
    below = Window.partitionBy("conv_id", "unit_depth").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    told = shared.select("a", "b", "conv_id", "depth", "parent_a", "parent_b", "n_shared", own.alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), unit.alias("unit_depth"))
    return told.withColumns({"leaves": F.sum("leaves").over(below), "saved": F.sum("saved").over(below)})


def peeled(units: DataFrame) -> DataFrame:
    """(unit, received_leaves, received_saved) of (unit, parent_unit, remaining, leaves, saved): what each unit's children have sent in the end.

    `remaining` counts the child units that a unit waits for, and `leaves` and `saved` are its own.
    """
    waiting = checkpointed(units.withColumns({"received_leaves": F.lit(0).cast("long"), "received_saved": F.lit(0).cast("long")}))
    finished = None
    left = waiting.count()
    while left:
        done = waiting.where("remaining = 0")
        sent = done.where("parent_unit is not null").groupBy(F.col("parent_unit").alias("unit")).agg(F.count("*").alias("n"), F.sum(F.col("leaves") + F.col("received_leaves")).alias("more_leaves"), F.sum(F.col("saved") + F.col("received_saved")).alias("more_saved"))
        told = done.select("unit", "received_leaves", "received_saved")
        finished = told if finished is None else finished.union(told)
        zero = lambda c: F.coalesce(c, F.lit(0))
        rest = waiting.where("remaining > 0").join(sent, "unit", "left").select(
            "unit", "parent_unit", (F.col("remaining") - zero("n")).alias("remaining"), "leaves", "saved",
            (F.col("received_leaves") + zero("more_leaves")).alias("received_leaves"), (F.col("received_saved") + zero("more_saved")).alias("received_saved"),
        )
        waiting, before = checkpointed(rest), left
        left = waiting.count()
        if left == before:
            raise RuntimeError("units wait for one another")
    return finished if finished is not None else waiting.select("unit", "received_leaves", "received_saved")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """A row for each node of the trie over (conv_id, part, pos, x, y, bytes)."""
    rows = checkpointed(members(rebuilt))
    nodes = rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "parent_a", "parent_b", "bytes")])
    nodes = checkpointed(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") > 1, 1)).alias("n_shared"))
    counted = checkpointed(nodes.join(children, ["a", "b"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "n_shared")}))
    parented = checkpointed(_with_parents(counted))
    told = checkpointed(_units(parented))
    unit_of = F.struct("conv_id", "unit_depth")
    # A unit's last node is its parent's end: child units hang from there.
    ends = told.groupBy("conv_id", "unit_depth").agg(F.max_by(F.struct("a", "b", "n_shared"), "depth").alias("end"), F.min_by(F.struct("parent_a", "parent_b", "leaves", "saved"), "depth").alias("top"))
    tops = ends.select(unit_of.alias("unit"), F.col("end.n_shared").alias("remaining"), "top.*")
    hangs = ends.select(F.col("end.a").alias("parent_a"), F.col("end.b").alias("parent_b"), unit_of.alias("parent_unit"))
    received = peeled(tops.join(hangs, ["parent_a", "parent_b"], "left").select("unit", "parent_unit", "remaining", "leaves", "saved"))
    totals = told.withColumn("unit", unit_of).join(received, "unit", "left").select("a", "b", (F.col("leaves") + F.col("received_leaves")).alias("n_leaves"), (F.col("saved") + F.col("received_saved")).alias("saved_tokens"))
    digests = ends_digests(rows.where("ends"))
    found = parented.join(totals, ["a", "b"], "left").join(digests, ["a", "b"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations (conv_id, turn, role, text) after turns are shared within groups of ids."""
    return prefix_trie(with_shared_turns(numbered_turns(conversations)))


#: SQL without message passing: every node meets its ancestors. crc32 is made bit by bit.
ORACLE_SQL = f"""
with bits as (
  select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, {0xEDB88320}) else c >> 1 end) as v from range(256) r(i))
), turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, strlen(coalesce(text, '')) as bytes
  from conversations where conv_id is not null
), ids as (
  select conv_id as c, conv_id - conv_id % {GROUP} as donor,
    xor({0xFFFFFFFF}, list_reduce(list_concat([{0xFFFFFFFF}], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {MOST_SHARED} as h
  from (select distinct conv_id from turns), bits
), rebuilt as (
  select c, 1 as part, pos, k, bytes from ids join turns on conv_id = donor where pos <= h union all select c, 2, pos, k, bytes from ids join turns on conv_id = c where pos > h
), placed as (
  select c, row_number() over (partition by c order by part, pos) as d, k, bytes from rebuilt
), members as (
  select c, d, string_agg(k, '') over (partition by c order by d) as path, bytes from placed union all select c, 0, '', 0 from ids
), last_turns as (
  select c, max(d) as d from members group by c
), nodes as (
  select path, m.d as depth, min(m.c) as conv_id, count(*) as n_convs, any_value(bytes) as bytes, coalesce(string_agg(cast(m.c as varchar), ',' order by m.c) filter (m.d = l.d), '') as ends
  from members m join last_turns l on m.c = l.c group by path, m.d
), children as (
  select left(path, 32 * (depth - 1)) as path, count(*) as n from nodes where depth > 0 group by 1
), sums as (
  select left(b.path, 32 * up.i) as path, sum(case when x.n is null then 1 else 0 end) as n_leaves, sum((b.n_convs - 1) * b.bytes) as saved
  from (select *, unnest(range(depth + 1)) as i from nodes) up join nodes b on b.path = up.path left join children x on x.path = b.path group by 1
)
select a.conv_id, a.depth, p.conv_id as parent_conv_id, a.n_convs, coalesce(x.n, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(a.ends) as ends_sha256
from nodes a join sums on sums.path = a.path left join children x on x.path = a.path left join nodes p on a.depth > 0 and p.path = left(a.path, 32 * (a.depth - 1))
"""
