"""Reconciliation of streams, by Structured Streaming.

Rows come from files. Append mode emits a window, or a row without a partner,
once the watermark has passed it; `staged` therefore closes its stream with a row far in the
future, which moves the watermark past all others and is dropped from results.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ledgerline.sources.shared import shared_folder
from ledgerline.sources.store import EvaluationStore

CLOSING = "2100-01-01 00:00:00"
#: State that has timers is kept in RocksDB, whose size isn't bounded by the executors' heaps.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _closed_by(zoned: DataFrame, ts: str) -> DataFrame:
    """One row at CLOSING, null but for its time."""
    return zoned.sparkSession.range(1).select(*[(F.lit(CLOSING) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in zoned.schema])


def staged(rows: DataFrame, ts: str, delay: str, files_at_once: int | None = None) -> DataFrame:
    """`rows` as a stream with a watermark on `ts`, closed by a row at CLOSING.

    A stream's watermark needs timestamps with a zone, which `ts` is cast to.
    `files_at_once` makes micro-batches of so many files.
    """
    spark = rows.sparkSession
    path = new_folder(spark, "stream")
    zoned = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    zoned.write.parquet(f"{path}/part=0")
    _closed_by(zoned, ts).write.parquet(f"{path}/part=1")
    reader = spark.readStream.schema(zoned.schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(f"{path}/part=*").withWatermark(ts, delay)


def run_arrivals(arrivals: list[DataFrame], ts: str, delay: str, change) -> DataFrame:
    """What comes out of a stream whose rows arrive one table after the other, and then the closing row.

    `change` makes the streaming result from the stream. Each arrival is processed
    to its end, and state and watermark go on from one to the next, so that rows which an arrival
    brings too late are dropped as they would be in a stream that never stops.
    """
    spark = arrivals[0].sparkSession
    path, out = new_folder(spark, "stream"), new_folder(spark, "stream-out")
    zoned = [rows.withColumn(ts, F.col(ts).cast("timestamp")) for rows in arrivals]
    result = None
    for i, rows in enumerate([*zoned, _closed_by(zoned[0], ts)]):
        rows.write.parquet(f"{path}/part={i}")
        result = change(spark.readStream.schema(zoned[0].schema).parquet(f"{path}/part=*").withWatermark(ts, delay))
        _start(result, out).awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def before_closing(ts: str) -> Column:
    return F.col(ts) < F.lit(CLOSING).cast("timestamp")


def _start(stream: DataFrame, out: str):
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()


class _LateRows(StreamingQueryListener):
    """Adds up the late rows of every batch of one query."""

    def __init__(self):
        self.batches: dict[str, dict[int, int]] = {}
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.setdefault(str(p.runId), {})[p.batchId] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of_run(self, run: str, seconds: int = 120) -> int:
        """Late rows of a run that is over. Events come in order, so the end is heard of after all batches."""
        with self.changed:
            if not self.changed.wait_for(lambda: run in self.ended, seconds):
                raise RuntimeError("the listener has not heard of all batches, so late rows can't be counted")
        return sum(self.batches.get(run, {}).values())


def run_counting_late(stream: DataFrame) -> tuple[DataFrame, int]:
    """Process all that a stream has now, in append mode: what came out, and how many rows were too late.

    Late rows are counted as Spark does, after rows of one batch and key are combined,
    over all batches: a listener hears of each, where the query itself remembers the last alone.
    """
    spark = stream.sparkSession
    out, late = new_folder(spark, "stream-out"), _LateRows()
    spark.streams.addListener(late)
    try:
        query = _start(stream, out)
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out), late.of_run(str(query.runId))
    finally:
        spark.streams.removeListener(late)


def run_to_end(stream: DataFrame) -> DataFrame:
    """What came out of a stream, however many rows were late."""
    out = new_folder(stream.sparkSession, "stream-out")
    _start(stream, out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def into_store(stream: DataFrame, store: EvaluationStore, name: str, state: str | None = None) -> None:
    """Add all that a stream has now to a store, each micro-batch as an evaluation of its own that its manifest completes.

    A batch that comes again, because the stream failed before it could note it in `state`, or
    lost that folder, is stored once: it is known by its number.
    """
    folder = state or new_folder(stream.sparkSession, "stream-state")
    writer = stream.writeStream.foreachBatch(lambda batch, n: store.append_batch(name, batch, n) and None)
    writer.option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def windowed_totals(stream: DataFrame, ts: str, width: str, by: str) -> DataFrame:
    """Counts and sums by tumbling windows of event time; late rows count until the watermark passes their window."""
    grouped = stream.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "total")


def deduplicated(stream: DataFrame, key: str) -> DataFrame:
    """The first row of each key; state goes once the watermark has passed it."""
    return stream.dropDuplicatesWithinWatermark([key])


def interval_joined(left: DataFrame, right: DataFrame, key: str, within: str, how: str) -> DataFrame:
    """Join of streams (key, left_ts, ...) and (right_key, right_ts, ...) whose times are at most `within` apart.

    Both watermarks and the bound let Spark drop state, and emit outer rows.
    """
    near = F.expr(f"{key} = right_key and right_ts >= left_ts - interval {within} and right_ts <= left_ts + interval {within}")
    return left.join(right, near, how)


#: Slots to which keys are dealt by hash. A slot's keys have one state, of rows: a call for each slot and batch reads it and
#: one writes it, where a state for each key would take several calls for each key. What is rewritten are the slots that a batch has rows of.
SLOTS = 1024


def _slotted(stream: DataFrame, key: str, slots: int, *columns: Column):
    """The stream's rows by `slot`: (slot, known, key, *columns), `known` telling whether there is a key."""
    whole = isinstance(stream.schema[key].dataType, T.IntegralType)
    # Whole numbers beside nulls would be floats in pandas.
    filled = F.coalesce(key, F.lit(0).cast(stream.schema[key].dataType)).alias(key) if whole else F.col(key)
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot")
    return stream.select(slot, F.col(key).isNotNull().alias("known"), filled, *columns).groupBy("slot")


class _Positions(StatefulProcessor):
    """A slot's state: of each of its keys, how many rows it has had, their units, and when it will have been idle for too long."""

    def __init__(self, key: str, kind: str, idle_ms: int):
        self.key, self.kind, self.idle_ms = key, kind, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("positions", f"{self.key} {self.kind}, rows long, units long, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k: (n, units, ends) for k, n, units, ends in self.state.get()}
        timer = min((ends for _, _, ends in held.values()), default=None)
        last: dict = {}
        for batch in rows:
            for k, known, units, at in zip(*(batch[c].tolist() for c in (self.key, "known", "units", "at")), strict=True):
                k = k if known else None
                n, total, ends = held.get(k, (0, 0, 0))
                held[k] = n + 1, total + units, ends
                last[k] = max(last.get(k, ends - self.idle_ms), at)
        soonest = timerValues.getCurrentWatermarkInMs() + 1
        for k, at in last.items():
            held[k] = *held[k][:2], max(at + self.idle_ms, soonest)
        self._keep(held, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The timer is the slot's first; others that are over by now go with it.
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        closed, held = [], {}
        for k, n, units, ends in self.state.get():
            if ends <= over:
                closed.append((k, n, units, "overdrawn" if units < 0 else "covered"))
            else:
                held[k] = n, units, ends
        self._keep(held, None)
        if closed:
            # As objects: whole numbers beside nulls would be floats.
            yield pd.DataFrame(closed, columns=[self.key, "rows", "units", "position"], dtype=object)

    def _keep(self, held: dict, timer: int | None) -> None:
        """Keep a slot's keys, and one timer for the first that will be over."""
        if held:
            self.state.put([(k, *of_key) for k, of_key in held.items()])
        else:
            self.state.clear()
        first = min((ends for _, _, ends in held.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def close(self) -> None:
        pass


def closed_positions(stream: DataFrame, key: str, ts: str, idle_seconds: int, slots: int = SLOTS) -> DataFrame:
    """A keyed state machine with timers: of each key, when it has been idle for so long, its rows, units, and whether it is overdrawn.

    State goes with the timer that ends it, so what is kept are the keys of late;
    a key that comes back begins anew. Rows of a null key are one key's. Start it within `rocksdb_state`.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = _slotted(stream.where(before_closing(ts)), key, slots, F.coalesce(F.col("units").cast("long"), F.lit(0)).alias("units"), F.unix_millis(ts).alias("at"), F.col(ts))
    return rows.transformWithStateInPandas(_Positions(key, kind, idle_seconds * 1000), f"{key} {kind}, rows long, units long, position string", "append", "eventTime")


class _Balances(StatefulProcessor):
    """A slot's state: of each of its keys and kinds, how many rows it has had and their units."""

    def __init__(self, key: str, key_kind: str):
        self.key, self.key_kind = key, key_kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balances = handle.getListState("balances", f"{self.key} {self.key_kind}, kind string, rows long, units long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(k, kind): (n, units) for k, kind, n, units in self.balances.get()}
        for batch in rows:
            for k, known, kind, units in zip(*(batch[c].tolist() for c in (self.key, "known", "kind", "units")), strict=True):
                at = k if known else None, None if pd.isna(kind) else kind
                n, total = held.get(at, (0, 0))
                held[at] = n + 1, total + units
        self.balances.put([(*at, *of_kind) for at, of_kind in held.items()])
        return iter(())

    def close(self) -> None:
        pass


def kept_balances(stream: DataFrame, key: str, kind: str, ts: str, slots: int = SLOTS) -> DataFrame:
    """A keyed state machine that gives no rows, and keeps of each key and kind, as text, how many rows it has had and their units.

    `state_rows` reads what it keeps. Null keys are one key and null kinds one kind. Start it within `rocksdb_state`.
    """
    key_kind = stream.schema[key].dataType.simpleString()
    rows = _slotted(stream.where(before_closing(ts)), key, slots, F.col(kind).cast("string").alias("kind"), F.coalesce(F.col("units").cast("long"), F.lit(0)).alias("units"))
    return rows.transformWithStateInPandas(_Balances(key, key_kind), f"{key} {key_kind}", "append", "none")


def run_keeping(stream: DataFrame, folder: str) -> None:
    """Process all that a stream has now, with its state and progress in `folder`; a later run goes on from there."""
    stream.writeStream.outputMode("append").format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def state_rows(spark: SparkSession, folder: str, variable: str, batch: int | None = None) -> DataFrame:
    """What a stream keeps in a list variable of its state, one row for each element.

    It is the state after the last batch, or after `batch`, as long as the stream's folder has that. Each partition of the state is a task's work.
    """
    reader = spark.read.format("statestore").option("stateVarName", variable)
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(folder).select("list_element.*")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that start within keep their state in RocksDB, as state with timers has to."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)
