"""Benchmark decontamination with suffix arrays over the training words.

Each slice of documents is a shard with a suffix array of its own. A benchmark word never seen in a document, or a document
word that no benchmark item has, ends every verbatim match, so the array covers the runs of benchmark words that are long
enough for a window and loses no match. Every test suffix is binary-searched in every shard.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessera.llm.batches import slices, texts
from tessera.session import ship

WINDOW = 10
#: Text bytes of the benchmark that are broadcast in one block; more items go in further blocks, one in memory at a time.
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z, keeps 0-9, a-z and all bytes outside ASCII, and turns the rest into spaces.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Items:
    """A block of benchmark items: word numbers, their suffixes, and the distinct windows with the items that have them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        split = [words(t) for _, t in items]
        self.vocab = {w: n for n, w in enumerate(sorted(set().union(*split)), 1)}
        self.words = np.array([self.vocab[w] for s in split for w in s] + [0], np.int32)
        self.suffix_item = np.repeat(np.arange(len(split)), [len(s) for s in split])
        ends = np.cumsum([len(s) for s in split])
        self.suffix_len = ends[self.suffix_item] - np.arange(len(self.suffix_item)) if split else np.zeros(0, np.int64)
        self.suffix_at = np.arange(len(self.suffix_item)) - (ends - [len(s) for s in split])[self.suffix_item] if split else np.zeros(0, np.int64)
        found: dict[bytes, list] = {}
        at = 0
        self.window_of = np.full(len(self.suffix_item), -1)  # the window that a suffix begins with
        for item, s in enumerate(split):
            length = min(window, len(s))
            for start in range(at, at + len(s) - length + 1) if s else ():
                own = found.setdefault(self.words[start : start + length].tobytes(), [start, length, set(), len(found)])
                own[2].add(item)
                self.window_of[start] = own[3]
            at += len(s)
        self.starts = np.array([f[0] for f in found.values()], np.int64)
        self.lengths = np.array([f[1] for f in found.values()], np.int64)
        self.owners = [sorted(f[2]) for f in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0


def suffix_array(c: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of `c` in order; 0 ends a suffix and is not a start itself. By prefix doubling."""
    rank, step = np.unique(c, return_inverse=True)[1].astype(np.int64), 1
    rank[c == 0] = 0
    if not (c == 0).any():
        rank += 1
    live = np.flatnonzero(c)
    while len(live):
        further = np.where(live + step < len(c), rank[np.minimum(live + step, len(c) - 1)], 0)
        further[_crosses(c, live, step)] = 0
        key, new = np.unique(rank[live] * (len(c) + 1) + further, return_inverse=True)
        rank[live] = new + 1
        step *= 2
        if len(key) == len(live) or not further.any():
            break
    return live[np.argsort(rank[live], kind="stable")]


def _crosses(c: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Whether a 0 lies within the first `step` words from `at`."""
    zeros = np.r_[0, np.cumsum(c == 0)]
    return zeros[np.minimum(at + step, len(c))] > zeros[at]


class Shard:
    """The suffix array of one slice of documents, restricted to runs of at least `shortest` benchmark words."""

    def __init__(self, tokens: np.ndarray, shortest: int):
        inside = np.r_[0, (tokens != 0).astype(np.int8), 0]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = (last - first >= max(1, shortest)) if shortest else np.zeros(len(first), bool)
        first, size = first[long], (last - first)[long]
        # Runs side by side with a 0 between them; `origin` leads back to positions in `tokens`.
        total = int(size.sum() + len(size))
        begin = np.cumsum(np.r_[0, size + 1])[:-1]
        self.origin = np.arange(total) + np.repeat(first - begin, size + 1)
        self.c = np.where(np.isin(np.arange(total), begin + size), 0, tokens[np.minimum(self.origin, len(tokens) - 1)]) if total else np.zeros(0, np.int32)
        self.order = suffix_array(self.c)

    def _compare(self, at: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of suffix minus query on the query's words, and the number of equal words."""
        sign, same, open_ = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64), np.arange(len(at))
        k = 0
        while len(open_):
            open_ = open_[lengths[open_] > k]
            spot = at[open_] + k
            a = np.where(spot < len(self.c), self.c[np.minimum(spot, len(self.c) - 1)], 0)
            b = words[starts[open_] + k]
            sign[open_] = np.sign(a.astype(np.int64) - b)
            open_ = open_[a == b]
            same[open_] += 1
            k += 1
        return sign, same

    def _bound(self, words, starts, lengths, upper: bool) -> np.ndarray:
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            sign, _ = self._compare(self.order[mid], words, starts[open_], lengths[open_])
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    def occurrences(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, position in tokens) of every occurrence of every query."""
        if not len(self.order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self._bound(words, starts, lengths, False), self._bound(words, starts, lengths, True)
        n = high - low
        query = np.repeat(np.arange(len(starts)), n)
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return query, self.origin[self.order[spot]]

    def longest(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and first position (in tokens) of the longest verbatim matches of every suffix; 0 below `least` words.

        The neighbours of a suffix's place in the order have its longest match, and those around that share it lie together.
        """
        best, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(self.order):
            spot = self._bound(words, starts, lengths, False)
            for near in (spot - 1, spot):
                ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
                _, same = self._compare(self.order[near[ok]], words, starts[ok], lengths[ok])
                best[ok] = np.maximum(best[ok], same)
            best[best < least] = 0
            ok = np.flatnonzero(best)
            query, at = self.occurrences(words, starts[ok], best[ok])
            if len(ok):
                place[ok] = np.minimum.reduceat(at, np.flatnonzero(np.diff(query, prepend=-1)))
        return best, place

    def search(self, block: Items) -> tuple[np.ndarray, ...]:
        """Every suffix of the block: its longest match and where; then all places of the windows that begin with a match."""
        if not len(block.starts):
            return (np.zeros(0, np.int64),) * 4
        least = np.where(block.window_of >= 0, block.lengths[block.window_of], np.iinfo(np.int64).max)
        best, place = self.longest(block.words, np.arange(len(least)), block.suffix_len, least)
        some = np.unique(block.window_of[best > 0])
        query, at = self.occurrences(block.words, block.starts[some], block.lengths[some])
        return best, place, some[query], at


def _blocks(benchmark: DataFrame, window: int) -> list:
    """Broadcasts of the benchmark, each of BLOCK_BYTES of text or one longer item; rows stream through the driver."""
    spark, block, size, out = benchmark.sparkSession, [], 0, []
    ship(spark)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    for name, text in rows.toLocalIterator():
        data = text.encode("utf-8", "replace")
        if block and size + len(data) > BLOCK_BYTES:
            out.append(spark.sparkContext.broadcast(Items(block, window)))
            block, size = [], 0
        block.append((name or "", data))
        size += len(data)
    return [*out, spark.sparkContext.broadcast(Items(block, window))] if block else out


def _tokens(split: list[list[bytes]], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all documents with a 0 after each, and where each document starts."""
    parts = [x for s in split for x in (np.fromiter(map(vocab.get, s, repeat(0)), np.int32, len(s)), np.zeros(1, np.int32))]
    starts = np.cumsum([0, *(len(s) + 1 for s in split)])
    return np.concatenate(parts), starts


def _held(blocks: list):
    """The values of the broadcasts; with several, a worker lets one go before it loads the next."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hits, longest.

    Words are maximal runs of [0-9a-z] and characters outside ASCII after lower-casing A-Z. A window is `window`
    consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any
    occurrence of a window is hit. `items` are the distinct item_ids (as strings, sorted) with occurring windows,
    items_sha256 digests them comma-joined, `hits` lists the hit stretches as (start, end) in words, end exclusive. Of each
    test suffix `longest` has its longest verbatim match, of a window at least, in the shard where that begins in this
    document (item_id, item_word, n_words, doc_word; `longest_matches` gives the longest over all shards).

    A null or empty text has no words and is clean; so is everything against an empty benchmark. A null item_id counts as
    the empty string, a null item text as no words. Repeated documents, items and windows are each answered in full.
    Only the named columns are read. No shuffle: documents stay where they are read, the benchmark is broadcast in blocks
    of bounded size, and the work of a shard is linear in its words and the occurrences in them.
    """
    found = _found(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits", "longest")


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    blocks = _blocks(benchmark, window)

    def run(batches):
        for batch in slices(batches, limit=(4 << 20) if len(blocks) < 2 else (32 << 20)):
            ids = batch.column("doc_id")
            batch = batch.take(pc.sort_indices(ids))  # null last; the first place of a match is that of the smallest doc_id
            split = [words(t) for t in texts(batch)]
            count = np.array([len(s) for s in split], np.int64)
            starts = np.cumsum([0, *(count + 1)])
            change = np.zeros(starts[-1] + 1, np.int32)
            owned: list[set] = [set() for _ in split]
            longest: list[list] = [[] for _ in split]
            for block in _held(blocks):
                tokens, _ = _tokens(split, block.vocab)
                best, place, query, at = Shard(tokens, block.shortest).search(block)
                np.add.at(change, at, 1)
                np.add.at(change, at + block.lengths[query], -1)
                doc = np.searchsorted(starts, at, side="right") - 1
                for d, q in np.unique(np.stack([doc, query], 1), axis=0).tolist():
                    owned[d].update(block.names[i] for i in block.owners[q])
                some = np.flatnonzero(best)
                doc = np.searchsorted(starts, place[some], side="right") - 1
                for d, i, item, n, p in zip(doc.tolist(), block.suffix_at[some].tolist(), block.suffix_item[some].tolist(), best[some].tolist(), (place[some] - starts[doc]).tolist()):
                    longest[d].append({"item_id": block.names[item], "item_word": i, "n_words": n, "doc_word": p})
            hit = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            inside = np.r_[0, np.cumsum(hit)]
            n_hit = inside[starts[1:]] - inside[starts[:-1]]
            stretch = np.searchsorted(first, starts)
            names = [sorted(o) for o in owned]
            hits = [
                [{"start": int(a - starts[i]), "end": int(b - starts[i])} for a, b in zip(first[lo:hi], last[lo:hi])] if hi > lo else []
                for i, (lo, hi) in enumerate(zip(stretch[:-1], stretch[1:]))
            ]
            match = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("n_words", pa.int64()), ("doc_word", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(count),
                    pa.array(n_hit.astype(np.int64)),
                    pa.array([len(n) for n in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string()),
                    pa.array(n_hit > 0),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(longest, pa.list_(match)),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits", "longest"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, "
        "hits array<struct<start: bigint, end: bigint>>, longest array<struct<item_id: string, item_word: bigint, n_words: bigint, doc_word: bigint>>",
    )


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every suffix of every item with a match of at least its window: item_id, item_word, n_words, doc_id, doc_word.

    The longest verbatim match over all shards and one location of it (smallest doc_id, null last, then first word). Items
    that share an item_id share their rows. The shards' answers are those of `contamination`.
    """
    found = _found(docs, benchmark, window).where("contaminated").select("doc_id", F.explode("longest").alias("m")).select("doc_id", "m.*")
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", F.expr("~doc_id"), F.expr("~doc_word")))
    return found.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no window: judged and filtered in one pass, without a join."""
    blocks = _blocks(benchmark, window)

    def run(batches):
        for batch in slices(batches, limit=(4 << 20) if len(blocks) < 2 else (32 << 20)):
            split = [words(t) for t in texts(batch)]
            bad = np.zeros(len(split), bool)
            for block in _held(blocks):
                if len(block.starts):
                    tokens, starts = _tokens(split, block.vocab)
                    *_, at = Shard(tokens, block.shortest).search(block)
                    bad[np.searchsorted(starts, at, side="right") - 1] = True
            yield batch.filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)
