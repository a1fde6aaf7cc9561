"""Logs that are changed by what is written beside them, and merged when they are read.

A log is three append-only Parquet tables under one root, partitioned by generation:

    base      the calls
    changes   paths of changed files; calls with an id below `before` that list such a path are stale
    cuts      ids below which calls no longer count

`operators.history.merged` puts them together. Compaction writes what a reader sees as the next generation, `cuts` last;
readers take the newest generation that has cuts, so one that was cut off is not seen and is written again. One
writer at a time appends or compacts; readers keep the generation before.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.history import merged, slashes
from tessera.scratch import discard, materialise, remove


#: Ranges that ids are counted in at a time.
RANGES = 1000


def greatest(ids: DataFrame, k: int) -> int | None:
    """The k-th greatest of ids (id), with repeats; the least if there are fewer, one more than the greatest for k = 0, null for none.

    Ids are counted in equal ranges, then in ranges of the one that the k-th falls in, and so on: seven scans of one column
    at most, none of which sorts or gathers ids, whatever k is.
    """
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if n == 0:
        return None
    if k <= 0 or k >= n:
        return high + 1 if k <= 0 else low
    while low < high:
        width = (high - low) // RANGES + 1
        part = F.expr(f"(cast(id as decimal(20, 0)) - {low}) div {width}")
        counts = dict(ids.where(F.col("id").between(low, high)).groupBy(part.alias("part")).count().collect())  # RANGES rows at most
        for i in sorted(counts, reverse=True):
            if k <= counts[i]:
                break
            k -= counts[i]
        low, high = low + i * width, min(high, low + (i + 1) * width - 1)
    return low


class Overlay:
    """`columns` are those of a call besides its id. With `files` (array<string>) and `stale` (boolean), calls can become stale."""

    def __init__(self, spark: SparkSession, root: str, columns: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {"base": f"id long, {columns}", "changes": "path string, before long", "cuts": "keep_from long"}
        for name, schema in self.schemas.items():  # so that there is something to read
            empty = spark.createDataFrame([], f"{schema}, generation int")
            empty.write.mode("ignore").partitionBy("generation").parquet(f"{self.root}/{name}")

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schemas[name]}, generation int").parquet(f"{self.root}/{name}")

    def _generation(self) -> int:
        return self._all("cuts").agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def _tables(self) -> list[DataFrame]:
        generation = self._generation()
        return [self._all(n).where(F.col("generation") == generation).drop("generation") for n in self.schemas]

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        out = rows.select(*columns).withColumn("generation", F.lit(self._generation()))
        out.write.mode("append").partitionBy("generation").parquet(f"{self.root}/{name}")

    def append(self, calls: DataFrame) -> None:
        """Add calls, whose ids grow with time. Those without an id cannot be told older or newer and do not count."""
        self._append("base", calls)

    def change(self, paths: DataFrame, before: int) -> None:
        """Calls with an id below `before` that list one of `paths` (path) are stale from now on."""
        self.changes(paths.select("path", F.lit(before).cast("long").alias("before")))

    def changes(self, rows: DataFrame) -> None:
        """Likewise for rows (path, before). No call is rewritten; the latest change of a path is written once."""
        self._append("changes", rows.where("path is not null").groupBy(slashes(F.col("path")).alias("path")).agg(F.max("before").alias("before")))

    def prune(self, keep: int) -> None:
        """Only the newest `keep` calls count from now on, and those that share an id with the last of them. Writes one number."""
        base, changes, cuts = self._tables()
        last = greatest(merged(base.select("id"), changes, cuts), keep)
        self._append("cuts", self.spark.createDataFrame([(last,)], "keep_from long"))

    def read(self) -> DataFrame:
        """The calls as they stand."""
        return merged(*self._tables())

    def stored(self) -> DataFrame:
        """One row with the rows of base, changes and cuts that a reader merges: what compaction would save."""
        base, changes, cuts = (t.agg(F.count(F.lit(1)).alias(n)) for t, n in zip(self._tables(), self.schemas))
        return base.crossJoin(changes).crossJoin(cuts)

    def compact(self) -> int:
        """Write what `read` returns as the next generation and return its number. Ids grow and a change marks calls before it, so no later call needs the changes that this folds in."""
        rows, generation = materialise(self.read()), self._generation() + 1
        nothing = self.spark.range(1).select(F.lit(None).cast("long").alias("keep_from"))
        for name, df in (("base", rows), ("cuts", nothing)):
            out = df.withColumn("generation", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("generation").parquet(f"{self.root}/{name}")
        discard(rows)
        for name in self.schemas:
            remove(self.spark, f"{self.root}/{name}/generation={generation - 2}")
        return generation
