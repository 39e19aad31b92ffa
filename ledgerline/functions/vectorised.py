"""Functions over Arrow batches, for what built-in functions don't offer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.shared import checkpointed, shuffle_partitions

#: Rows of a group that one worker takes at a time.
GROUP_ROWS = 1 << 17


@F.pandas_udf(T.IntegerType())
def check_digit(numbers: pd.Series) -> pd.Series:
    """The digit that makes a number pass the Luhn test."""
    values = numbers.fillna(0).to_numpy(np.int64)
    total, place = np.zeros(len(values), np.int64), 0
    while values.any():
        digit = values % 10
        if place % 2 == 0:
            digit = np.where(digit > 4, 2 * digit - 9, 2 * digit)
        total, values, place = total + digit, values // 10, place + 1
    return pd.Series((10 - total % 10) % 10).where(numbers.notna())


@F.pandas_udf(T.LongType())
def net_position(units: pd.Series, rows: pd.Series) -> int:
    """A custom aggregate over distinct values and how many rows have each: the sum of units beyond their most frequent value (the least, in ties).

    A key's rows are counted by value first, so that what a worker gets is its distinct values.
    """
    known = units.notna()
    units, rows = units[known].to_numpy(np.int64), rows[known].to_numpy(np.int64)
    if not len(units):
        return 0
    most = units[rows == rows.max()].min()
    return int((units * rows).sum() - rows.sum() * most)


def drawdowns(rows: DataFrame, key: str, order: str, amount: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, drawdown_units): of each key, how far its running sum of whole units falls below an earlier peak at most.

    Rows are dealt by ranges of (key, order) into groups of about `group_rows`, whatever the
    number of rows and however many a key has. A group gives one row for each key
    in it, its total, highest and lowest running sum and own fall, and those
    are put in order natively.
    """
    groups = max(shuffle_partitions(rows.sparkSession), math.ceil(rows.count() / group_rows))
    units = rows.select(key, order, F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("units"))
    dealt = units.repartitionByRange(groups, key, order, "units").withColumn("_group", F.spark_partition_id())

    def summed(group: pa.Table) -> pa.Table:
        group = group.sort_by([(key, "ascending"), (order, "ascending"), ("units", "ascending")])
        # Keys as Arrow has them: pandas would make floats of whole numbers beside a null.
        keys = group[key].combine_chunks().dictionary_encode(null_encoding="encode")
        by = keys.indices.to_numpy()
        running = group["units"].to_pandas().groupby(by).cumsum()
        fall = running.groupby(by).cummax() - running
        found = [group["units"].to_pandas().groupby(by).sum(), running.groupby(by).max(), running.groupby(by).min(), fall.groupby(by).max()]
        columns = [keys.dictionary, *[pa.array(c.to_numpy(np.int64)) for c in found], pa.array([group["_group"][0].as_py()] * len(keys.dictionary), pa.int32())]
        return pa.table(columns, names=[key, "total", "highest", "lowest", "fall", "_group"])

    kind = rows.schema[key].dataType.simpleString()
    pieces = checkpointed(dealt.groupBy("_group").applyInArrow(summed, f"{key} {kind}, total long, highest long, lowest long, fall long, _group int"))
    before = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    started = pieces.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))
    peaked = started.withColumn("peak", F.greatest(F.lit(0), F.max(F.col("start") + F.col("highest")).over(before)))
    return peaked.groupBy(key).agg(F.max(F.greatest("fall", F.col("peak") - F.col("start") - F.col("lowest"), F.lit(0))).alias("drawdown_units"))


@F.udtf(returnType=T.StructType().add("part", T.IntegerType()).add("due_units", T.LongType()))
class Instalments:
    """Splits units into parts that differ by one at most, earlier parts larger."""

    def eval(self, units: int, parts: int) -> Iterator[tuple[int, int]]:
        if units is None or not parts:
            return
        each, left = divmod(units, parts)
        for part in range(parts):
            yield part, each + (part < left)
