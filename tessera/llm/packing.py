"""Packing by lexical retrieval: shards of a BM25 inverted index give each seed its unused neighbours, which fill its window.

Shards are dealt by content, not by place. A document's features are its token ids and the pairs of ids inside its words;
under a random order of features, weighted so that rare ones come first, two documents have the same first feature with the
probability of their weighted overlap, however large the corpus is. So the documents of one first feature, a cell, are the
likely neighbours. Each round has an order of its own and so another shard for each seed: the first rounds join documents
with close neighbours of their cell, the last one fills windows by BM25 over everything in its shard.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.batches import release_memory, slices, texts
from tessera.llm.encoder import SLICE_BYTES, SYMBOLS, encoder
from tessera.scratch import materialise

WINDOW = 2048
#: Documents of a shard, about. Cells are dealt to shards by a hash; larger cells are split by their next features.
SHARD_DOCS = 1536
#: Documents of a cell that are compared with one another at once, in order of their next feature.
RUN = 64
#: Rounds before the last. A neighbour is close if its score is at least this share of the seed's score of itself.
ROUNDS, CLOSE = 1, 0.5
#: Features are hashed to so many, and tasks that first add up their counts, which are a vector of that length for each task.
FEATURES, ADDING = 1 << 20, 32
#: Terms of a shard, those of the longest postings, whose weights are a dense matrix, and seeds scored at once. Both change
#: time only.
DENSE, AT_ONCE = 512, 32
K1, B = 1.2, 0.75


class Index:
    """BM25 postings (term-major) of the documents of one shard, with document frequencies of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = self.n = len(docs)
        lengths = np.array([len(t) for t in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        key = flat * max(1, n) + np.repeat(np.arange(n), lengths)
        small = not len(key) or key.max() < 2**31
        key, tf = np.unique(key.astype(np.int32) if small else key, return_counts=True)
        term, self.doc = key // max(1, n), (key % max(1, n)).astype(np.int64)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1.0))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.terms = np.split(term[by := np.argsort(self.doc, kind="stable")], np.cumsum(np.bincount(self.doc[by], minlength=n))[:-1]) if n else []
        self.size = np.bincount(term, minlength=len(idf))
        self.at = np.cumsum(self.size) - self.size
        hot = np.argsort(-self.size, kind="stable")[:DENSE]
        hot = hot[self.size[hot] * 16 > n]
        self.column = np.full(len(idf), -1)
        self.column[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), n))
        row = self.column[term]
        self.dense[row[row >= 0], self.doc[row >= 0]] = self.weight[row >= 0]

    def rows(self, seeds: list[int]) -> np.ndarray:
        """BM25 of all documents for each seed: all distinct terms of the seed count, each once."""
        query = np.zeros((len(seeds), len(self.dense)))
        rest = []
        for q, seed in zip(query, seeds):
            column = self.column[self.terms[seed]]
            q[column[column >= 0]] = 1
            rest.append(self.terms[seed][column < 0])
        out = query @ self.dense
        for row, terms in zip(out, rest):
            size = self.size[terms]
            if len(terms):
                spot = np.repeat(self.at[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
                row += np.bincount(self.doc[spot], self.weight[spot], self.n)
        return out

    def scores(self, doc: int) -> np.ndarray:
        return self.rows([doc])[0]


def _taken(order: np.ndarray, rest: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(document, ids) of the first documents in order that fill `room`, the last one cut to fit."""
    total = np.cumsum(rest[order])
    k = int(np.searchsorted(total, room)) + 1
    out = [(d, int(rest[d])) for d in order[:k].tolist()]
    if k <= len(order):
        out[-1] = (out[-1][0], out[-1][1] - int(total[k - 1]) + room)
    return out


def fill(lengths: list[int], rows, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) that hold all ids of documents of `lengths`.

    A window starts with a seed, the first document with unused text, and takes unused text of others by falling score
    (ties in order) until it is full; the last of them is cut to fit, and its rest stays unused. rows(seeds) scores all
    documents for each seed. Every window is full but what is left in the end, which is dealt over powers of two, so
    nothing needs padding.
    """
    lengths = np.array(lengths, np.int64)
    rest, out, ahead = lengths.copy(), [], {}
    for seed in range(len(lengths)):
        while rest[seed]:
            pieces = [(seed, int(lengths[seed] - rest[seed]), n := int(min(window, rest[seed])))]
            rest[seed] -= n
            if n < window:
                others = np.flatnonzero(rest)
                if seed not in ahead:
                    some = [seed, *others[: AT_ONCE - 1].tolist()]
                    ahead = dict(zip(some, rows(some)))
                score, room = ahead[seed][others], window - n
                k = 1 + int(2 * room / max(1.0, rest[others].mean())) if len(others) else 0
                while k < len(others):  # the best k, in full order, if their text is enough
                    top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                    if rest[others[top]].sum() >= room:
                        others, score = others[top], score[top]
                        break
                    k *= 4
                for doc, n in _taken(others[np.argsort(-score, kind="stable")], rest, room):
                    pieces.append((doc, int(lengths[doc] - rest[doc]), n))
                    rest[doc] -= n
            out.append(pieces)
    if not out or (left := sum(n for *_, n in out[-1])) == window:
        return out
    current = out.pop()
    while left:
        size, part = min(window, 1 << (left.bit_length() - 1)), []
        left -= size
        while size:
            doc, at, n = current.pop(0)
            part.append((doc, at, min(n, size)))
            if n > size:
                current.insert(0, (doc, at + size, n - size))
            size -= min(n, size)
        out.append(part)
    return out


def join_close(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> tuple[list, list]:
    """Windows, and unfinished ones, of the (document, start, length) of a few documents shorter than a window.

    Each seed takes unused documents that score at least CLOSE of what it scores itself, by falling score, until its
    window is full; the rest of a document that is cut becomes an unfinished window of its own.
    """
    lengths = np.array([len(d) for d in docs], np.int64)
    term, local = np.unique(np.concatenate(docs), return_inverse=True)
    tf = np.bincount(np.repeat(np.arange(len(docs)), lengths) * len(term) + local, minlength=len(docs) * len(term)).reshape(len(docs), -1)
    norm = K1 * (1 - B + B * lengths / max(mean_length, 1.0))
    weight = idf[term] * tf * (K1 + 1) / (tf + norm[:, None])
    scores = (tf > 0).astype(float) @ weight.T
    rest, done, open_ = lengths.copy(), [], []
    for seed in range(len(docs)):
        if not rest[seed]:
            continue
        pieces, room = [(seed, int(lengths[seed] - rest[seed]), int(rest[seed]))], window - int(rest[seed])
        rest[seed] = 0
        near = np.flatnonzero((rest > 0) & (scores[seed] >= CLOSE * scores[seed, seed]) & (scores[seed] > 0))
        for doc, n in _taken(near[np.argsort(-scores[seed, near], kind="stable")], rest, room):
            pieces.append((doc, int(lengths[doc] - rest[doc]), n))
            rest[doc] -= n
            room -= n
        (open_ if room else done).append(pieces)
    return done, open_


class Features:
    """Random orders of hashed features in which rare ones tend to come first: `first` gives each text's first one.

    `seen` has, for each feature, the number of texts with it, of n texts.
    """

    def __init__(self, seen: np.ndarray, n: int, begins: np.ndarray, orders: int):
        self.begins = begins
        weight = np.log1p(max(1, n) / (seen + 0.5)) ** 3
        rng = np.random.default_rng(7)
        # The first arrival of exponential clocks, each as fast as its feature's weight.
        self.ranks = [np.argsort(np.argsort(rng.exponential(size=FEATURES) / weight)).astype(np.int32) for _ in range(orders)]

    def first(self, flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """First features, in each order, of texts of some ids one after another; an empty text has 0."""
        out = [np.zeros(len(lengths), np.int32) for _ in self.ranks]
        if len(flat):
            alone, pair, inside = _features(flat, lengths, self.begins)
            some = np.flatnonzero(lengths)
            starts = (np.cumsum(lengths) - lengths)[some]
            for found, rank in zip(out, self.ranks):
                least = rank[alone]
                np.minimum(least[1:], np.where(inside, rank[pair], np.int32(FEATURES)), out=least[1:])
                found[some] = np.minimum.reduceat(least, starts)
        return out


def _features(flat: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, by a multiplicative hash, of texts one after another: those of ids, those of pairs, and which pairs count:
    not if the second begins a word or another text."""
    wide = flat.astype(np.uint64) + np.uint64(1)
    hashed = [(x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int32) for x in (wide, wide[:-1] * np.uint64(1 << 32) + wide[1:])]
    inside = ~begins[flat[1:]]
    inside[(np.cumsum(lengths) - lengths)[np.flatnonzero(lengths)][1:] - 1] = False
    return *hashed, inside


def _ownwith(flat: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each feature, how many of the texts have it."""
    if not len(flat):
        return np.zeros(FEATURES, np.int64)
    alone, pair, inside = _features(flat, lengths, begins)
    text = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) * FEATURES
    own = np.sort(np.concatenate([text + alone, (text[1:] + pair)[inside]]))
    return np.bincount(own[np.flatnonzero(np.diff(own, prepend=-1))] & (FEATURES - 1), minlength=FEATURES)


def _added(batches):
    """One row with the sum of the vectors in column seen, a row at a time."""
    total = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for row in batch.column("seen"):
            total += np.frombuffer(row.as_buffer(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()])], names=["seen"])


def _feature_counts(coded: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts: a vector of FEATURES numbers, by two steps of which the second adds ADDING vectors."""
    some = coded.where("seen is not null").select("seen").coalesce(ADDING).mapInArrow(_added, "seen binary")
    return np.frombuffer(some.repartition(1).mapInArrow(_added, "seen binary").first().seen, "<i8")


def _sharded(items: DataFrame, first: str, then: str) -> DataFrame:
    """`items` with a column shard: cells (equal `first`) are dealt to shards of about SHARD_DOCS by a hash, hot ones are split.

    A cell larger than a shard is split by `then`, the first feature in a second order, and what is equal in that too, as
    copies are, by row number. Only counts of hot cells, at most FEATURES, and of hot parts of them are joined.
    """
    n = items.count()
    parts = -(-n // SHARD_DOCS)
    hot = items.groupBy(first).agg(F.ceil(F.count(F.lit(1)) / SHARD_DOCS).alias("split")).where("split > 1")
    hot = materialise(hot)
    out = items
    if hot.isEmpty():
        out = out.withColumn("shard", F.struct(F.pmod(F.xxhash64(first), F.lit(max(1, parts))).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")))
        return out
    out = out.join(hot, first, "left").withColumn("part", F.when(F.col("split").isNotNull(), F.pmod(F.xxhash64(then, first), "split")))
    crowd = materialise(
        out.where("part is not null").groupBy(first, "part").agg(F.ceil(F.count(F.lit(1)) / SHARD_DOCS).alias("crowd")).where("crowd > 2")
    )
    out = out.join(crowd, [first, "part"], "left")
    a = F.when(F.col("part").isNull(), F.pmod(F.xxhash64(first), F.lit(max(1, parts)))).otherwise(-1 - F.col(first).cast("long"))
    b, c = F.coalesce("part", F.lit(0)).cast("long"), F.coalesce(F.pmod(F.xxhash64("number"), "crowd"), F.lit(0)).cast("long")
    return out.withColumn("shard", F.struct(a.alias("a"), b.alias("b"), c.alias("c"))).drop("split", "part", "crowd")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
ITEM = "doc_ids array<bigint>, numbers array<bigint>, starts array<bigint>, lengths array<bigint>, totals array<bigint>, tail binary"
_LISTS = [f.split()[0] for f in ITEM.split(", ")][:-1]
_PIECE_TYPES = [(f.split()[0], pa.int64()) for f in PIECE.split(", ")[:-1]] + [("ids", pa.list_(pa.int32()))]


class _Items:
    """Rows of a shard: texts of less than a window, each of one piece of a document or several."""

    def __init__(self, table: pa.Table, kind: str, with_ids: bool):
        self.lists = {c: table.column(c).to_pylist() for c in _LISTS}
        self.tails = [np.frombuffer(t, kind) for t in table.column("tail").to_pylist()]
        self.with_ids, self.rows = with_ids, []

    def parts(self, item: int, at: int, n: int) -> list[tuple]:
        """Pieces (doc_id, number, start, length, total, place in the item's text) of n ids of an item from `at`."""
        out, begin = [], 0
        for doc_id, number, start, length, total in zip(*(self.lists[c][item] for c in _LISTS)):
            low, high = max(at, begin), min(at + n, begin + length)
            if low < high:
                out.append((doc_id, number, start + low - begin, high - low, total, low))
            begin += length
        return out

    def emit(self, pieces: list[tuple[int, int, int]]) -> None:
        """One finished sequence. It is named by the number of its first id, which no other sequence holds."""
        offset, name = 0, None
        for item, at, n in pieces:
            for doc_id, number, start, length, total, low in self.parts(item, at, n):
                name = number + start if name is None else name
                ids = self.tails[item][low : low + length].astype("<u4")
                self.rows.append((doc_id, start, length, zlib.crc32(ids.tobytes()), total, name, offset, ids.tolist() if self.with_ids else None))
                offset += length

    def finished(self) -> pa.Table:
        columns = list(zip(*self.rows)) or [[]] * len(_PIECE_TYPES)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _PIECE_TYPES)], names=[n for n, _ in _PIECE_TYPES])

    def joined(self, pieces: list[tuple[int, int, int]]) -> tuple:
        parts = [p for item, at, n in pieces for p in self.parts(item, at, n)]
        text = np.concatenate([self.tails[item][at : at + n] for item, at, n in pieces])
        return (*(list(c) for c in list(zip(*parts))[:5]), text.tobytes())


_ORDER = [("doc_id", "ascending"), ("total", "ascending"), ("start", "ascending"), ("tail", "ascending")]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1, with_ids: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    A document's ids are those of the tokenizer file without special tokens, then `end_id`. Whole windows of a document
    are sequences of their own; its tail, shorter than a window, is packed with its lexical neighbours: first with close
    ones of its cell, `rounds` times, then by BM25 over its shard (see the module). Sequences hold `window` ids or a power of
    two. Which pieces share a sequence depends on the rows alone, except among crowds of copies: these are split by row
    number, and so by partitions, as are the numbers that name sequences. A null or empty text is the end id alone. Rows with null or repeated doc_ids are packed as documents
    of their own, ties in order of doc_id, then text. Other columns are not read; an empty table gives an empty result.

    Plan: one Arrow pass encodes whole texts, keeps tails and checksums, and counts document frequencies of the ids and of the
    features of all tails, a vector as long as the vocabulary and one of FEATURES for each task; that table is written once. The
    summed vectors (bounded by the vocabulary and by FEATURES) are broadcast, the second as feature orders, and a pass over the
    tails finds their first features. Each round shuffles the tails once, to shards of bounded size: hot cells are split, so a group of copies with a
    third of all rows makes many shards. All work is linear in the number of tails; the driver holds nothing by document.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    width = 1 + max(max(spec["model"]["vocab"].values()), end_id, *(t["id"] for t in spec["added_tokens"]), 0)
    kind = "<u2" if width <= 1 << 16 else "<u4"
    each = np.dtype(kind).itemsize
    docs = docs.select("doc_id", "text")
    source = spark.sparkContext.broadcast(text)
    begins = np.ones(width, bool)  # ids that begin a word: with a space, or without any letter
    for token, i in spec["model"]["vocab"].items():
        begins[i] = token[0] == SYMBOLS[32] or not token.isalpha()
    shared = spark.sparkContext.broadcast(begins)
    firsts = [f"f{i}" for i in range(2 * (rounds + 1))]
    release_memory()

    def encode(batches):
        own, begins, ending = encoder(source.value), shared.value, np.array([end_id], "<u4").tobytes()
        df, features, number = np.zeros(width, np.int64), np.zeros(FEATURES, np.int64), TaskContext.get().partitionId() << 40
        for batch in slices(batches, limit=SLICE_BYTES):
            raws = own.ids(texts(batch))
            flat = np.frombuffer(b"".join([x for raw in raws for x in (raw, ending)]), "<u4")
            size = np.array([len(raw) // 4 + 1 for raw in raws], np.int64)
            del raws
            end = np.cumsum(size)
            rest = size % window
            at = np.cumsum(rest) - rest
            spot = np.repeat(end - rest - at, rest)
            tails = flat[spot + np.arange(len(spot))]
            seen = np.sort(np.repeat(np.arange(len(size)) << 32, rest) | tails)
            df += np.bincount(seen[np.flatnonzero(np.diff(seen, prepend=-1))] & 0xFFFFFFFF, minlength=width)
            checks, kept = [[] for _ in size], [[] for _ in size]
            for d in np.flatnonzero(size >= window).tolist():
                parts = flat[end[d] - size[d] : end[d] - rest[d]].reshape(-1, window)
                checks[d] = [zlib.crc32(p.tobytes()) for p in parts]
                kept[d] = [p.astype(kind).tobytes() for p in parts] if with_ids else []
            ends = pa.py_buffer((np.r_[0, at + rest] * each).astype(np.int32))
            columns = [pa.array(size), pa.array(checks, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.binary()))]
            columns.append(pa.Array.from_buffers(pa.binary(), len(size), [None, ends, pa.py_buffer(tails.astype(kind))]))
            columns.append(pa.array(number + end - size))
            features += _ownwith(tails, rest, begins)
            number += int(end[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.nulls(len(size), pa.list_(pa.int64())), pa.nulls(len(size), pa.binary())], names=names)
        if df.any():
            counts = [pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([features.astype("<i8").tobytes()])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.nulls(1, t) for t in types), *counts], names=names)

    def ordered(batches):
        order = features.value
        for batch in batches:
            own = [np.frombuffer(t.as_buffer(), kind) for t in batch.column("tail")]
            found = order.first(np.concatenate(own) if own else np.zeros(0, kind), np.array([len(t) for t in own], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, *firsts])

    names = ["doc_id", "n_tokens", "crcs", "whole", "tail", "number", "df", "seen"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.int64()]
    fields = ", ".join(f"{f} int" for f in firsts)
    coded = materialise(
        docs.mapInArrow(encode, "doc_id long, n_tokens long, crcs array<bigint>, whole array<binary>, tail binary, number long, df array<bigint>, seen binary")
    )
    rows = coded.where("df is null").drop("df", "seen")
    tails = rows.where("octet_length(tail) > 0")
    n_docs, tail_bytes = tails.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("tail")), F.lit(0))).first()
    counted = coded.where("df is not null").select(F.posexplode("df").alias("term", "n")).where("n > 0")
    df = np.zeros(width)
    for term, n in counted.groupBy("term").agg(F.sum("n")).collect():
        df[term] = n
    features = spark.sparkContext.broadcast(Features(_feature_counts(coded), n_docs, begins, len(firsts)))
    release_memory()
    idf = spark.sparkContext.broadcast(np.log(1 + (n_docs - df + 0.5) / (df + 0.5)))
    mean = tail_bytes / each / max(1, n_docs)

    def close(cell: str, further: list[str]):
        def run(table: pa.Table) -> pa.Table:
            encoder.cache_clear()  # workers live on, and their caches with them
            table = table.sort_by([(cell, "ascending"), (further[0], "ascending"), *_ORDER])
            items, at = _Items(table, kind, with_ids), table.column(cell).to_numpy()
            ranks = [table.column(f).to_numpy() for f in further]
            edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            alone, made = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for a in range(lo, hi, RUN):
                    b = min(hi, a + RUN)
                    if b - a == 1:
                        alone.append(a)
                        continue
                    done, open_ = join_close(items.tails[a:b], idf.value, mean, window)
                    for pieces in done:
                        items.emit([(a + d, s, n) for d, s, n in pieces])
                    for pieces in open_:
                        if len(pieces) == 1 and pieces[0][1:] == (0, len(items.tails[a + pieces[0][0]])):
                            alone.append(a + pieces[0][0])
                        else:
                            made.append((*items.joined([(a + d, s, n) for d, s, n in pieces]), *(int(r[[a + d for d, *_ in pieces]].min()) for r in ranks)))
            same = table.select([*_LISTS, "tail", *further]).take(pa.array(alone, pa.int64()))
            joined = pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*made)) or [[]] * len(same.schema), same.schema)], schema=same.schema)
            release_memory()
            return pa.concat_tables([items.finished(), same, joined], promote_options="default")

        return run

    def best(table: pa.Table) -> pa.Table:
        items = _Items(table.sort_by(_ORDER), kind, with_ids)
        index = Index(items.tails, idf.value, mean)
        for pieces in fill([len(t) for t in items.tails], index.rows, window):
            items.emit(pieces)
        del index
        release_memory()
        return items.finished()

    def whole_windows(batches):
        for batch in batches:
            ids, totals, crcs, whole, number = (batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "crcs", "whole", "number"))
            out = [
                (ids[d], i * window, window, crc, totals[d], number[d] + i * window, 0, np.frombuffer(whole[d][i], kind).tolist() if with_ids else None)
                for d, checks in enumerate(crcs)
                for i, crc in enumerate(checks)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _PIECE_TYPES)], names=[n for n, _ in _PIECE_TYPES])

    length = (F.octet_length("tail") / each).cast("long")
    lists = [F.array(c).alias(n) for n, c in zip(_LISTS, ("doc_id", "number", F.col("n_tokens") - length, length, "n_tokens"))]
    items = materialise(tails.select(*lists, "tail").mapInArrow(ordered, f"{ITEM}, {fields}"))
    packed = rows.where(F.size("crcs") > 0).select("doc_id", "n_tokens", "crcs", "whole", "number").mapInArrow(whole_windows, PIECE)
    keys = [F.col(c)[0].alias(n) for c, n in (("doc_ids", "doc_id"), ("totals", "total"), ("starts", "start"), ("numbers", "number"))]
    for i in range(rounds):
        cell, then, further = firsts[2 * i], firsts[2 * i + 1], firsts[2 * i + 2 :]
        schema = f"{PIECE}, {ITEM}, {', '.join(f'{f} int' for f in further)}"
        dealt = _sharded(items.select("*", *keys), cell, then).groupBy("shard")
        found = materialise(dealt.applyInArrow(close(cell, further), schema))
        packed = packed.unionByName(found.where("tail is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"))
        items = found.where("tail is not null").select(*_LISTS, "tail", *further)
    packed = packed.unionByName(_sharded(items.select("*", *keys), *firsts[-2:]).groupBy("shard").applyInArrow(best, PIECE))
    return packed if with_ids else packed.drop("ids")
