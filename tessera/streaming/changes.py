"""File-change events: debounced per path, handed over in micro-batches, and running totals of tool calls."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.scratch import discard, materialise
from tessera.sources.walk import skipped

DEBOUNCE = "500 milliseconds"
# Extensions that are watched.
WATCHED = ("rs", "ts", "tsx", "js", "jsx", "py", "go", "java", "c", "h", "cpp", "cs", "html", "md", "json", "xml", "sql", "yaml", "yml")


def watched(events: DataFrame) -> DataFrame:
    """Events (path, op, ts) of watched extensions outside hidden and skipped folders."""
    return events.where(F.substring_index("path", ".", -1).isin(*WATCHED) & ~skipped(F.col("path")))


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str | None = "10 seconds") -> DataFrame:
    """(path, first, last, n_events) of bursts of changes to a path that are less than `gap` apart.

    Windows are per path, so a change of one file never cancels another's. Works on streams, where a burst is emitted when
    the watermark passes its end, and on batches.
    """
    changes = events.where("op <> 'delete'")
    if changes.isStreaming and late:
        changes = changes.withWatermark("ts", late)
    bursts = changes.groupBy("path", F.session_window("ts", gap).alias("w"))
    return bursts.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n_events")).drop("w")


def deletions(events: DataFrame) -> DataFrame:
    """Deletes are passed on at once."""
    return events.where("op = 'delete'").select("path", "ts")


def maintain(events: DataFrame, index: Callable[[DataFrame], None], remove: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run `remove` and `index` on the paths (a DataFrame) of each micro-batch of events; the last operation on a path counts.

    One row per path leaves the aggregate and is written once; nothing comes to the driver.
    """

    def batch(df: DataFrame, _: int) -> None:
        last = materialise(df.groupBy("path").agg(F.max_by("op", "ts").alias("op")))
        gone, changed = last.where("op = 'delete'").select("path"), last.where("op <> 'delete'").select("path")
        if not gone.isEmpty():
            remove(gone)
        if not changed.isEmpty():
            index(changed)
        discard(last)

    return watched(events).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_usage(calls: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, tool, calls, tokens) of a stream or table of calls (ts, tool, tokens)."""
    df = calls.withWatermark("ts", late) if calls.isStreaming else calls
    sums = df.groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    return sums.select(F.col("w.start").alias("window_start"), "tool", "calls", "tokens")
