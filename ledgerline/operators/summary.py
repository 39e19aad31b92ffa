"""Summaries of discrepancies: totals, subtotals, distinct counts, top rows, sets and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerline.sources.shared import checkpointed, shuffle_partitions


def _totals() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("delta").cast("decimal(38,2)").alias("sum_delta")]


def by_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(*_totals())


def subtotals(rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Totals by rollup or cube of `columns`, and which of them a row sums over (grouping_level)."""
    grouped = {"rollup": rows.rollup, "cube": rows.cube}[how](*columns)
    return grouped.agg(*_totals(), F.grouping_id().cast("int").alias("grouping_level"))


def grouping_sets(rows: DataFrame, columns: list[str], sets: list[list[str]]) -> DataFrame:
    """Totals by each of the sets of columns."""
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(*_totals(), F.grouping_id().cast("int").alias("grouping_level"))


def top_rows(rows: DataFrame, by: Column, ties: str, n: int) -> DataFrame:
    """The first n rows; each task keeps n at most."""
    return rows.orderBy(by, ties).limit(n)


def listed(rows: DataFrame, key: str, value: str, separator: str = ",") -> DataFrame:
    """Distinct values of each key, sorted and joined."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias("listed"))


def duplicates(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key others have too, with how many there are and their number among them, by `order`.

    Keys are counted first, so that only rows of repeated ones are put in order: by ranges of (key,
    order), so that a key with a third of all rows is many tasks' work. Null keys are alike.
    """
    counts = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(F.count("*").alias("copies")).where("copies > 1")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)])
    repeated = rows.join(counts, same).drop(*[f"_k{i}" for i in range(len(key))])
    placed = numbered(repeated, key, order)
    return placed.select(*rows.columns, "copies", F.col("place").cast("int").alias("copy_no"))


def numbered(rows: DataFrame, key: list[str], order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with their place within their key, from 1, by `order`; and of columns `sums`, the sum up to and with a row (sum_<column>).

    Rows are dealt by ranges of (key, order) and numbered within each; one row for each range
    and key tells what came before. Written to the checkpoint folder.
    """
    parts = checkpointed(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *key, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumns({"place": F.count("*").over(within), **{f"sum_{c}": F.sum(c).over(within) for c in sums}})
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.groupBy(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    starts = ranges.select("_p", *[f"_k{i}" for i in range(len(key))], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *[F.sum(f"_s_{c}").over(before).alias(f"_from_{c}") for c in sums])
    same = reduce(lambda a, b: a & b, [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]])
    joined = inside.join(starts, same)
    # A sum of nothing is null, on either side.
    total = lambda c: F.coalesce(F.col(f"_from_{c}") + F.col(f"sum_{c}"), f"_from_{c}", f"sum_{c}")
    return joined.select(*rows.columns, (F.col("_start") + F.col("place")).alias("place"), *[total(c).alias(f"sum_{c}") for c in sums])


def ranked(rows: DataFrame, key: str, order: str, ties: str) -> DataFrame:
    """`rows` with place, rank, dense_rank and quarter within their key, by descending `order`, then `ties`.

    Rows are dealt by ranges of (key, order, ties) and numbered within each, so that a key, or
    a value, with a third of all rows is many tasks' work. What came before is told
    by one row for each range and key: how many rows and values, and where the range's
    first value began, if in an earlier range. Nulls come last.
    """
    by, value = [key, F.col(order).desc_nulls_last(), F.col(ties)], F.struct(order)
    n = shuffle_partitions(rows.sparkSession)
    parts = checkpointed(rows.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", key)
    inside = parts.withColumns({"_place": F.row_number().over(within.orderBy(*by[1:])), "_rank": F.rank().over(within.orderBy(by[1])), "_dense": F.dense_rank().over(within.orderBy(by[1]))})
    ranges = inside.groupBy("_part", key).agg(
        F.count("*").alias("rows"), F.max("_dense").alias("values"), F.min_by(value, "_place").alias("first"), F.max_by(value, "_place").alias("last"), F.max("_rank").alias("last_begins")
    )
    across = Window.partitionBy(key).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"start": F.coalesce(F.sum("rows").over(before), F.lit(0)), "goes_on": F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(across)), F.lit(False))})
    ranges = ranges.withColumn("begins", F.when(~F.col("goes_on") | (F.col("values") > 1), F.col("start") + F.col("last_begins")))
    ranges = ranges.select(
        F.col("_part").alias("_p"), F.col(key).alias("_k"), "start", "goes_on", F.last("begins", ignorenulls=True).over(before).alias("began"),
        (F.coalesce(F.sum(F.col("values") - F.col("goes_on").cast("int")).over(before), F.lit(0)) - F.col("goes_on").cast("int")).alias("dense"), F.sum("rows").over(Window.partitionBy(key)).alias("of"),
    )
    joined = inside.join(ranges, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    place, each, left = F.col("start") + F.col("_place"), F.floor(F.col("of") / 4), F.col("of") % 4
    # As ntile(4): the first `left` quarters have one row more.
    larger = left * (each + 1)
    quarter = F.when(place <= larger, F.ceil(place / (each + 1))).otherwise(left + F.ceil((place - larger) / each))
    rank = F.when(F.col("goes_on") & (F.col("_dense") == 1), F.col("began")).otherwise(F.col("start") + F.col("_rank"))
    return joined.select(*rows.columns, *[c.cast("int").alias(name) for name, c in (("place", place), ("rank", rank), ("dense_rank", F.col("dense") + F.col("_dense")), ("quarter", quarter))])


def blocks(placed: DataFrame, key: list[str], before: int, after: int, size: int = 1 << 16) -> tuple[DataFrame, WindowSpec]:
    """Rows with their `place`, dealt to _block by `size` of a key's places, and a window over a block in order of them.

    A block has the last rows of the block before it and the first of that after it too (_own is
    false there), as many as `before` and `after` say: what frames of so many rows need.
    """
    at = F.col("place") - 1
    block, within = F.floor(at / size), at % size
    home = F.array(
        F.struct(block.alias("_block"), F.lit(True).alias("_own")),
        F.when(within >= size - before, F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))),
        F.when((within < after) & (block > 0), F.struct((block - 1).alias("_block"), F.lit(False).alias("_own"))),
    )
    return placed.select("*", F.inline(F.array_compact(home))), Window.partitionBy(*key, "_block").orderBy("place")


def until_next(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with `start`, their time (the first of `order`), and `end`, that of the next row of their key; null in the last."""
    dealt, w = blocks(numbered(rows, [key], order), [key], 0, 1)
    return dealt.withColumns({"start": F.col(order[0]), "end": F.lead(order[0]).over(w)}).where("_own").select(*rows.columns, "start", "end")


def movements(rows: DataFrame, key: str, order: list[str], block_rows: int = 1 << 16) -> DataFrame:
    """Running balance, the amounts before and after, the total of three rows and how many rows fall into the day up to each.

    Rows of a key are numbered over ranges and dealt to blocks of `block_rows` with their neighbours, so
    that a key with a third of all rows is many tasks' work. The rows of a day are those up to its end less those
    up to its start, both running counts over ranges. Null keys are one key; rows without a time come first, and their day is all of them.
    """
    money = "decimal(38,2)"
    placed = checkpointed(numbered(rows, [key], order, ("amount",)))
    dealt, w = blocks(placed, [key], 2, 1, block_rows)
    beside = dealt.withColumns({"previous": F.lag("amount").over(w), "following": F.lead("amount").over(w), "last_three": F.sum("amount").over(w.rowsBetween(-2, 0)).cast(money)}).where("_own")
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    rows_at = placed.select(key, at.alias("at"), F.col("place").alias("_row"))
    marks = F.inline(F.array(*[F.struct(when.alias("at"), F.lit(side).alias("side"), F.lit(int(side == 1)).alias("one")) for side, when in enumerate((F.col("at") - 86_400_000_000, F.col("at"), F.col("at")))]))
    counted = numbered(rows_at.select(key, "_row", marks), [key], ["at", "side", "_row"], ("one",))
    upto = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("sum_one"))), F.lit(0))
    days = counted.groupBy(F.col(key).alias("_k"), "_row").agg((upto(2) - upto(0)).alias("within_day"))
    joined = beside.join(days, F.col(key).eqNullSafe(F.col("_k")) & (F.col("place") == F.col("_row")))
    return joined.select(*rows.columns, F.col("sum_amount").cast(money).alias("balance"), "previous", "following", "last_three", "within_day")


def bucketed(rows: DataFrame, ts: str, width: str, slide: str | None, by: list[str]) -> DataFrame:
    """Counts and values by tumbling (or, with a slide, sliding) windows."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Runs of rows of a key without a gap as long as `gap`."""
    grouped = rows.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    return grouped.select(key, F.col("s.start").alias("session_start"), "last_ts", "n")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a beyond those that b has too, repeats counted."""
    return a.exceptAll(b.select(*a.columns))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b.select(*a.columns))


def together(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name; columns that one lacks are null."""
    return a.unionByName(b, allowMissingColumns=True)


#: log2 of the hashes that a sketch keeps. Up to so many distinct values it is exact, beyond its relative standard error is one over the root of their number.
LG_KEPT = 12


def distinct_sketches(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, rows, sketch): of each group a sketch of its distinct values, of bounded size, which can be stored and merged."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.theta_sketch_agg(value, LG_KEPT).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, sketch) over groups of stored sketches; as good as a sketch made in one pass over all their rows."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.theta_union_agg("sketch", LG_KEPT).alias("sketch"))


def estimated(sketches: DataFrame, errors: float = 3) -> DataFrame:
    """`sketches` with the estimate of their distinct values, and by how many it may be off: so many standard errors, or 0 where the sketch has kept all hashes."""
    estimate, kept = F.theta_sketch_estimate("sketch"), 1 << LG_KEPT
    bound = F.when(estimate <= kept, 0).otherwise(F.ceil(estimate * (errors / kept**0.5)))
    return sketches.withColumns({"estimate": estimate, "off_by_at_most": bound.cast("long")})


#: Distinct values for which a part of a group's sketch is meant: half of what it can keep, so that hashes that fall unevenly don't fill it.
PART_VALUES = 1 << (LG_KEPT - 1)


def sketch_parts(rows: DataFrame, value: str) -> int:
    """Parts to which values are dealt by hash so that the sketch of a part keeps the hashes of all its values: in proportion to all distinct ones."""
    distinct = rows.agg(F.approx_count_distinct(value)).first()[0]
    return -(-distinct // PART_VALUES) or 1


def dealt_sketches(rows: DataFrame, by: list[str], value: str, parts: int) -> DataFrame:
    """(by, part, rows, sketch): as distinct_sketches, a sketch for each of so many parts of the values, each of bounded size. Sketches of the same parts merge by (by, part)."""
    return distinct_sketches(rows.withColumn("part", F.pmod(F.xxhash64(value), F.lit(parts))), [*by, "part"], value)


def estimated_parts(dealt: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, estimate, off_by_at_most) over a group's parts, which share no value: exact, with a bound of 0, as long as each has kept all its hashes."""
    return estimated(dealt).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("rows", "estimate", "off_by_at_most")])
