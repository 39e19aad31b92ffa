"""Quantiles from summaries that merge: partial states made where the rows are, and combined in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.shared import checkpointed

#: States that one task merges at a time, above the level of a partition's batches.
FAN_IN = 16
_STATE = "rows long, off_by_at_most long, vals array<double>, weights array<long>"


def _shortened(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most `points` of the sorted values with all of the weight, and how far ranks are off by that.

    Neighbours of about equal weight together give all of it to the heaviest of them. Of those on one side of a
    limit only one such group is on both, so that a rank is off by what moved in one group.
    """
    if len(values) <= points:
        return values, weights, 0
    upto = np.cumsum(weights)
    group = (upto - 1) * points // upto[-1]
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    heaviest = np.lexsort((weights, group))[np.append(begins[1:], len(values)) - 1]
    together = np.add.reduceat(weights, begins)
    return values[heaviest], together, int((together - weights[heaviest]).max())


def _merged(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, int]:
    distinct, place = np.unique(values, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, weights)
    return _shortened(distinct, total, points)


def quantile_states(rows: DataFrame, key: str, value: str, points: int = 1024) -> DataFrame:
    """(key, rows, off_by_at_most, vals, weights): of each key's values a summary of `points` of them at most, however many rows it has.

    The number of a key's values up to any limit is told by the summary with an error of
    off_by_at_most, which is counted as states are made: 0 while a key has no more than `points` distinct
    values, else at most 1 / `points` of its rows for each level of the tree, batches and partitions being two. Rows without a value are left out; null keys are one key.

    Each batch of rows gives one state for each key in it, before anything is shuffled, so a key with a third of
    all rows is every task's work. States are merged by partition, and then by 16 at a time.
    """
    kind = rows.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            by, values = keys.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(by, kind="stable")
            ends = np.cumsum(np.bincount(by, minlength=len(keys.dictionary)))
            states = [(len(v), *_merged(v, np.ones(len(v), np.int64), points)) for v in np.split(values[order], ends[:-1])] if len(by) else []
            node = pa.array([batch.column(2)[0].as_py()] * len(states), pa.int32()) if states else pa.array([], pa.int32())
            arrays = [pa.array([n for n, *_ in states], pa.int64()), pa.array([s[3] for s in states], pa.int64()), pa.array([s[1] for s in states], pa.list_(pa.float64())), pa.array([s[2] for s in states], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([keys.dictionary, *arrays, node], names=[key, "rows", "off_by_at_most", "vals", "weights", "_node"])

    known = rows.select(key, F.col(value).cast("double").alias("_value"), F.spark_partition_id().alias("_node")).where("_value is not null")
    return _combined(checkpointed(known.mapInArrow(partial, f"{key} {kind}, {_STATE}, _node int")), key, points)


def merged_quantile_states(states: DataFrame, key: str, points: int = 1024) -> DataFrame:
    """States made apart (by day, say), merged by `key`, which they have beside their own columns; errors add up."""
    dealt = states.select(key, "rows", "off_by_at_most", "vals", "weights", F.spark_partition_id().alias("_node"))
    return _combined(checkpointed(dealt), key, points)


def _combined(states: DataFrame, key: str, points: int) -> DataFrame:
    kind = states.schema[key].dataType.simpleString()

    def merge(group: pa.Table) -> pa.Table:
        flat = lambda name: group[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values, weights, off = _merged(flat("vals"), flat("weights"), points)
        total = lambda name: sum(group[name].to_pylist())
        columns = [group[key].combine_chunks()[:1], [total("rows")], [total("off_by_at_most") + off], pa.array([values], pa.list_(pa.float64())), pa.array([weights], pa.list_(pa.int64())), group["_node"].combine_chunks()[:1]]
        return pa.table(columns, names=[key, "rows", "off_by_at_most", "vals", "weights", "_node"])

    # The first pass puts a partition's batches together, the others 16 nodes each, up to the root.
    top = (states.agg(F.max("_node")).first()[0] or 0) * FAN_IN
    while True:
        states = checkpointed(states.groupBy(key, "_node").applyInArrow(merge, f"{key} {kind}, {_STATE}, _node int"))
        top //= FAN_IN
        if not top:
            return states.drop("_node")
        states = states.withColumn("_node", F.floor(F.col("_node") / FAN_IN).cast("int"))


def quantile(permille: int) -> Column:
    """Of a state, the least value that at least so many thousandths of its rows don't exceed."""
    reached = f"(a.upto + x.weights) * 1000 >= rows * {permille}"
    step = f"(a, x) -> named_struct('upto', a.upto + x.weights, 'found', coalesce(a.found, case when {reached} then x.vals end))"
    return F.expr(f"aggregate(arrays_zip(vals, weights), named_struct('upto', 0L, 'found', cast(null as double)), {step}, a -> a.found)")
