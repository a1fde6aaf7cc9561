"""Shards of near-equal bytes by minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tessera.scratch import materialise

#: The first summary has at most 2^FIRST_BITS cells; cells in which a cut may fall are split by STEP_BITS at a time.
FIRST_BITS, STEP_BITS = 14, 6
#: Rows that one slot numbering window holds on average.
WINDOW_ROWS = 4096


class Cells:
    """Sizes of consecutive key ranges in key order. A cell of one group is atomic; others may still be split."""

    def __init__(self, cells: list[tuple[int, int, int, bool]]):
        self.cells = sorted(cells)  # (first key, bits, size, atomic)
        self.ends = []
        total = 0
        for _, _, size, _ in self.cells:
            total += size
            self.ends.append(total)
        self.total = total
        self.starts = [0, *self.ends[:-1]]

    def reach(self, start: int, capacity: int, fluid: bool) -> int:
        """The furthest cut at most `capacity` after `start`: at a cell's end or, if fluid, also inside cells not atomic."""
        most = start + capacity
        if most >= self.total:
            return self.total
        n = bisect_right(self.ends, most)
        cut = self.ends[n - 1] if n else 0
        return most if fluid and not self.cells[n][3] else max(cut, start)

    def cuts(self, capacity: int, shards: int, fluid: bool = False) -> list[int] | None:
        """Greedy cuts, or None if `shards` shards of this capacity don't hold everything."""
        at, out = 0, []
        for _ in range(shards):
            at = self.reach(at, capacity, fluid)
            out.append(at)
        return out if at >= self.total else None

    def least(self, shards: int, fluid: bool) -> int:
        """The smallest feasible capacity, by binary search over greedy checks."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards, fluid) else (mid + 1, high)
        return low

    def unclear(self, shards: int) -> list[tuple[int, int]]:
        """(first key, bits) of the cells that must be split to know the capacity exactly; empty when it is known."""
        low, high = self.least(shards, True), self.least(shards, False)
        if low == high:
            return []
        at_least, at_most, found = 0, 0, set()
        for _ in range(shards):
            at_least, at_most = self.reach(at_least, low, False), self.reach(at_most, high, True)
            for n in range(max(0, bisect_left(self.ends, at_least)), len(self.cells)):
                if self.starts[n] >= at_most:
                    break
                if not self.cells[n][3]:
                    found.add(self.cells[n][:2])
        return sorted(found)

    def balanced(self, shards: int) -> list[int]:
        """First keys of shards 1, 2, ...: no shard exceeds the least capacity, and what is left is dealt evenly.

        A greedy cut alone would fill the first shards and leave the last ones empty where one group is very large. Each
        cut goes to the boundary nearest to an even share of the rest, between what the rest needs and what fits.
        """
        capacity = self.least(shards, False)
        latest = [self.total]  # latest[j]: the earliest start from which j shards of the capacity hold the rest
        for _ in range(shards):
            need = latest[-1] - capacity
            latest.append(0 if need <= 0 else self.starts[bisect_left(self.starts, need)] if need <= self.starts[-1] else latest[-1])
        keys, at = [], 0
        for left in range(shards - 1, 0, -1):
            want = at + (self.total - at) / (left + 1)
            fits = self.reach(at, capacity, False)
            n = bisect_left(self.ends, want)
            options = [e for e in (*self.ends[max(0, n - 1) : n + 1], fits, max(at, latest[left])) if max(at, latest[left]) <= e <= fits]
            at = min(options, key=lambda e: (abs(e - want), e)) if options else fits
            n = bisect_left(self.starts, at)
            keys.append(self.cells[n][0] if n < len(self.cells) else None)
        return keys


def _summary(groups: DataFrame, bits: int, within: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, bool]]:
    cell = F.shiftright("k", 64 - bits)
    df = groups
    if within is not None:
        by_bits: dict[int, list[int]] = {}
        for first, b in within:
            by_bits.setdefault(b, []).append(first >> (64 - b))
        df = df.where(" OR ".join(f"shiftright(k, {64 - b}) IN ({', '.join(map(str, v))})" for b, v in by_bits.items()))
    rows = df.groupBy(cell.alias("cell")).agg(F.sum("size"), F.count(F.lit(1))).collect()
    return [(c << (64 - bits), bits, size, n == 1) for c, size, n in rows]


def minimax_cuts(groups: DataFrame, shards: int) -> list[int | None]:
    """First keys of shards 1 to shards-1 for `groups` (k long, size long; k unique), such that the largest is least.

    The driver sees sums over key ranges only: at most 2^FIRST_BITS cells, then the few cells in which a cut may fall,
    split until lower and upper bound of the capacity meet. None: no group left for that shard and the ones after it.
    """
    cells = _summary(groups, FIRST_BITS)
    while True:
        now = Cells(cells)
        unclear = now.unclear(shards) if cells else []
        if not unclear:
            return now.balanced(shards) if cells else [None] * (shards - 1)
        bits = min(64, min(b for _, b in unclear) + STEP_BITS)
        split = [c for c in unclear if c[1] < bits]
        gone = set(split)
        cells = [c for c in cells if c[:2] not in gone] + _summary(groups, bits, split)


def balanced_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    size is the UTF-8 length of the text (null: none) plus 8. Rows with equal texts (null equals empty) form an atomic
    group, keyed and ordered by a 64-bit hash of the text; a hash collision would only tie two groups together. Shards
    are contiguous ranges of that order, cut so that the largest shard is as small as any contiguous cut allows. slot
    numbers the rows of a shard from 0 without gaps, in no stated order. Null doc_ids, repeated rows and ties are placed
    like any row. Other columns are not read. An empty table gives an empty result; fewer groups than shards leave shards
    empty.

    Built-in functions only. Whole texts are read once into narrow rows. Groups and their sums over key ranges are partial
    aggregates. The cuts become literals of a column expression, so no join assigns shards. Slots come from windows over
    (shard, hash of the row) buckets of bounded mean size and the running sums of their counts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k"),
        )
    )
    groups = materialise(rows.groupBy("k").agg(F.sum("size").alias("size")))
    shard: Column = F.lit(0)
    for key in minimax_cuts(groups, shards):
        if key is not None:
            shard = shard + F.when(F.col("k") >= key, 1).otherwise(0)
    buckets = max(1, rows.count() // (shards * WINDOW_ROWS))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k", "size"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "k", "size"))
    numbered = placed.withColumn("number", number)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("number") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
