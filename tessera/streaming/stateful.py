"""Streams with state of their own: bursts that timers close, and the newest rows of a log."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.history import KEPT_SEARCHES
from tessera.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BURST = "path string, first timestamp, last timestamp, n_events long"
SLOTS = 16


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which timers and lists need; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def merged(bursts: np.ndarray, gap: int) -> np.ndarray:
    """Rows (first, last, events) in order, those joined that are at most `gap` apart."""
    if len(bursts) < 2:
        return bursts
    bursts = bursts[np.argsort(bursts[:, 0], kind="stable")]
    reach = np.maximum.accumulate(bursts[:, 1])
    starts = np.concatenate([[0], np.flatnonzero(bursts[1:, 0] - reach[:-1] > gap) + 1])
    ends = np.concatenate([starts[1:], [len(bursts)]]) - 1
    return np.stack([bursts[starts, 0], reach[ends], np.add.reduceat(bursts[:, 2], starts)], axis=1)


class _Debounce(StatefulProcessor):
    """The open burst of a path, in microseconds and events, and one timer that closes it."""

    def __init__(self, gap: int, wait: int):
        self.gap, self.wait = gap, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long")

    def _out(self, key, bursts: np.ndarray) -> pd.DataFrame:
        times = [pd.to_datetime(bursts[:, i], unit="us") for i in (0, 1)]
        return pd.DataFrame({"path": pd.Series([key[0]] * len(bursts), dtype=object), "first": times[0], "last": times[1], "n_events": bursts[:, 2]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [self.open.get()] if self.open.exists() else []
        bursts = np.array(held, np.int64).reshape(-1, 3)
        for chunk in rows:  # in memory is one chunk, and the bursts so far
            ts = chunk["micros"].to_numpy(np.int64)
            bursts = merged(np.concatenate([bursts, np.stack([ts, ts, np.ones_like(ts)], axis=1)]), self.gap)
        self.open.update(tuple(int(x) for x in bursts[-1]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield self._out(key, bursts[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self._out(key, np.array([self.open.get()], np.int64))
            self.open.clear()

    def close(self) -> None:
        pass


def debounced_by_timer(events: DataFrame, gap_ms: int = 500, wait_ms: int | None = None) -> DataFrame:
    """(path, first, last, n_events) of bursts of changes of a stream (path, op, ts) at most `gap_ms` apart, append mode.

    As `changes.debounced`, but a path's last burst is handed over when `wait_ms` (by default the gap) have gone by on the
    clock without a change of that path, not when a later event moves a watermark. An event that comes after its burst was
    handed over opens another. Deletes, and rows without path or time, are no changes. Needs `state_store`.
    """
    ship(events.sparkSession)
    changes = events.where("op <> 'delete' and path is not null and ts is not null").select("path", F.unix_micros("ts").alias("micros"))
    processor = _Debounce(gap_ms * 1000, gap_ms if wait_ms is None else wait_ms)
    return changes.groupBy("path").transformWithStateInPandas(processor, outputStructType=BURST, outputMode="Append", timeMode="ProcessingTime")


class _Newest(StatefulProcessor):
    """The `keep` rows of greatest id of a slot. Rows of equal id all count, the greater text first."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "id long, row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=["id", "row"], dtype=object)
        for chunk in rows:
            best = pd.concat([best, chunk[["id", "row"]].astype(object)])
            best = best.sort_values(["id", "row"], ascending=False).head(self.keep)
        self.rows.put([(int(i), r) for i, r in zip(best["id"], best["row"])])
        yield best.assign(slot=key[0], id=best["id"].astype("int64"))[["slot", "id", "row"]]

    def close(self) -> None:
        pass


def rolling_history(searches: DataFrame, folder: str, checkpoint: str, keep: int = KEPT_SEARCHES, slots: int = SLOTS, **trigger) -> StreamingQuery:
    """Keep the newest `keep` rows of a stream of searches (id, ...) under `folder`, as they are after every micro-batch.

    Rows are dealt to `slots` by a hash of all they hold, each slot keeps its own newest in state, and a slot that has new rows
    is written anew as partition slot=N: so no task sees the whole stream, and what stands there is `slots` times `keep`
    rows at most. `read_history` gives the newest of all. Rows without id are left out. Needs `state_store`.
    """
    ship(searches.sparkSession)
    rows = searches.where("id is not null").select("id", F.to_json(F.struct(*searches.columns)).alias("row"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int"))
    newest = rows.groupBy("slot").transformWithStateInPandas(_Newest(keep), outputStructType="slot int, id long, row string", outputMode="Update", timeMode="None")

    def put(batch: DataFrame, _: int) -> None:
        batch.repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(folder)

    return newest.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_history(spark: SparkSession, folder: str, schema, keep: int = KEPT_SEARCHES) -> DataFrame:
    """The newest searches of all slots, as rows of `schema`."""
    rows = spark.read.schema("id long, row string, slot int").parquet(folder).orderBy(F.desc("id"), F.desc("row")).limit(keep)
    return rows.select(F.from_json("row", schema).alias("r")).select("r.*")
