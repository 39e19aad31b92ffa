"""Intervals that overlap, whatever their lengths, and lots used up in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.summary import numbered
from ledgerline.sources.shared import checkpointed

#: The blocks of 1, 2, 4, ... granules that cover granules a to b - 1 and nothing else, two of each size at most.
_COVER = """flatten(transform(sequence(0, length(bin(b - a)) - 1), l -> case when -shiftright(-a, l) < shiftright(b, l) then filter(array(
  case when -shiftright(-a, l) % 2 <> 0 then struct(l as level, -shiftright(-a, l) as node) end,
  case when shiftright(b, l) % 2 <> 0 then struct(l as level, shiftright(b, l) - 1 as node) end
), n -> n is not null) else array() end))"""


def _position(df: DataFrame, column: str) -> Column:
    """Times as microseconds, other numbers as they are."""
    return F.unix_micros(F.col(column).cast("timestamp")) if df.schema[column].dataType.typeName().startswith("timestamp") else F.col(column).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, key: str, granule: int = 20) -> DataFrame:
    """Pairs with an equal key whose intervals have something in common.

    Both have (key, id, start, end), intervals of times or whole numbers that hold their start and not
    their end. The result has key, left_id, right_id, and what they have in common as start
    and end. Intervals without a start or end, or that end where they start or before, overlap nothing; null keys equal nothing.

    Two intervals overlap where one holds the other's start. An interval is cut into the
    blocks of 1, 2, 4, ... granules of 2^granule (microseconds, 20: about a second)
    that make it up, and a start looks into the block of each size about it: an equality on
    key, size and block, whose work grows with pairs that do overlap, however long or short intervals are.
    A row is as many as twice the binary logarithm of its interval's granules, so a larger
    granule makes fewer rows, and more pairs that a comparison then drops at the intervals' ends.
    """
    a, b = (
        checkpointed(df.select(key, "id", "start", "end", _position(df, "start").alias("_from"), _position(df, "end").alias("_to")).where(f"_from < _to and {key} is not null"))
        for df in (left, right)
    )
    # Of two that start together the left one holds the right one's start, so each pair is found once.
    found = _holding(a, b, key, granule, "_from <= _at", ("left_id", "right_id")).unionByName(_holding(b, a, key, granule, "_from < _at", ("right_id", "left_id")))
    return found.select(key, "left_id", "right_id", "start", "end")


def _holding(intervals: DataFrame, starting: DataFrame, key: str, granule: int, holds: str, ids: tuple[str, str]) -> DataFrame:
    cut = intervals.withColumns({"a": F.expr(f"shiftright(_from, {granule})"), "b": F.expr(f"shiftright(_to - 1, {granule}) + 1")}).withColumn("cover", F.expr(_COVER))
    # 63 sizes at most.
    levels = sorted(r[0] for r in cut.select(F.explode("cover.level").alias("level")).distinct().collect())
    holders = cut.select(key, F.col("id").alias(ids[0]), F.col("end").alias("_held_to"), "_from", "_to", F.inline("cover"))
    looks = F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))
    starts = starting.select(key, F.col("id").alias(ids[1]), "start", "end", F.col("_from").alias("_at"), looks.alias("level")).withColumn("node", F.expr(f"shiftright(_at, {granule} + level)"))
    joined = holders.join(starts, [key, "level", "node"]).where(f"{holds} and _at < _to")
    return joined.select(key, *ids, "start", F.least("end", "_held_to").alias("end"))


def fifo_lots(rows: DataFrame, key: str, order: list[str], units: str, granule: int = 16) -> DataFrame:
    """(key, lot_id, disposal_id, units): of each key, which lots its disposals use up, first lots first.

    Rows are (key, id, units and what `order` names); those with units above zero are lots, those below are disposals, and the
    n-th unit disposed of is the n-th acquired, be that before or after. What of either side has no
    counterpart is in no row. Rows of no units, or of a null key, take no part; ids tell a side's rows apart.

    Running sums over ranges of (key, order) make each lot and each disposal an interval of units,
    and those that overlap belong together, so a key with a third of all rows is many tasks' work.
    """
    signed = F.col(units).cast("long")
    dealt = rows.where((signed != 0) & F.col(key).isNotNull()).select(key, "id", *[c for c in order if c != "id"], F.abs(signed).alias("_size"), (signed > 0).alias("_lot"))
    placed = checkpointed(numbered(dealt, [key, "_lot"], [*order, "id"] if "id" not in order else order, ("_size",)))
    spans = placed.select(key, "id", (F.col("sum__size") - F.col("_size")).alias("start"), F.col("sum__size").alias("end"), "_lot")
    found = overlap_join(spans.where("_lot"), spans.where("not _lot"), key, granule)
    return found.select(key, F.col("left_id").alias("lot_id"), F.col("right_id").alias("disposal_id"), (F.col("end") - F.col("start")).alias("units"))
