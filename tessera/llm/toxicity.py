"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of itself, a document the mean of its words, so a
misspelling never seen shares most of its vectors with the word it stands for. Embeddings and softmax weights are learned
together from the labelled sample by full-batch gradient descent with momentum, each embedding scaled by its curvature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tessera.llm.batches import PIECE_BYTES, Recent, pieces, release_memory, slices, texts
from tessera.llm.encoder import distinct_chunks
from tessera.scratch import materialise
from tessera.session import ship

#: Labelled rows that a model is fitted on at most: those whose doc_id has the smallest hashes.
SAMPLE_ROWS = 8000
#: Numbers of their vectors that the driver holds at most (8 bytes each); typical texts of 8,000 rows take a half.
SAMPLE_NUMBERS = 1 << 24
BUCKETS, DIM = 1 << 17, 8
NGRAMS = (3, 4)
#: Features of fewer labelled documents say nothing about others and keep zero vectors.
LEAST_DOCS = 8
#: Words with zero vectors that every document is averaged with, so that one word cannot decide for a very short text.
BLANKS = 20
#: RIDGE is the precision that the curvature of an embedding is at least taken to have, and its pull to zero.
STEPS, RATE, SOFT_RATE, MOMENTUM, RIDGE, SEED = 200, 0.05, 0.01, 0.9, 1e-9, 7
THRESHOLD = 0.3
#: Numbers of the fit that are sorted at once.
AT_ONCE = 1 << 20
CACHE = 300_000
#: Bytes of a word whose n-grams are in memory at once.
LONG = 1 << 14
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself and its character n-grams with marked ends (by byte; multi-byte characters stay together
    often enough for the purpose)."""
    marked = b"<" + word + b">"
    grams = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in (b"\x00" + word, *grams)]


def _long_features(word: bytes) -> Iterator[np.ndarray]:
    """The same of a long word, part by part."""
    yield np.array([zlib.crc32(b"\x00" + word) % BUCKETS], np.int64)
    marked = b"<" + word + b">"
    for lo in range(0, len(marked), LONG):
        part = marked[lo : lo + LONG + max(NGRAMS) - 1]
        grams = [part[i : i + n] for n in NGRAMS for i in range(min(LONG, len(part) - n + 1))]
        yield np.fromiter((zlib.crc32(g) % BUCKETS for g in grams), np.int64, len(grams))


def _bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of many words one after another, and how many each has."""
    parts, sizes = [np.zeros(0, np.int64)], []
    for lo in range(0, len(words), 20_000):
        some = words[lo : lo + 20_000]
        if max(map(len, some)) <= LONG and sum(map(len, some)) <= PIECE_BYTES:
            bag = list(map(features, some))
            sizes += map(len, bag)
            parts.append(np.fromiter(chain.from_iterable(bag), np.int64))
            continue
        for word in some:
            bag = [*_long_features(word)]
            sizes.append(sum(map(len, bag)))
            parts += bag
    return np.concatenate(parts), np.array(sizes, np.int64)


def bags(data: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the occurrences by number, and where each text's begin. "" is no word."""
    return distinct_chunks([t.translate(_WORDS) for t in data])


@dataclass
class Model:
    """Score of each bucket (embedding times softmax weight difference) and the bias; what scoring needs of the model."""

    weight: np.ndarray
    bias: float

    def words(self, words: list[bytes]) -> np.ndarray:
        """Class score of each word; the empty string is no word and scores 0."""
        means, short = np.zeros(len(words)), []
        for i, word in enumerate(words):
            if len(word) <= LONG:
                short.append(i)
                continue
            total = n = 0
            for part in _long_features(word):
                total, n = total + float(self.weight[part].sum(dtype=np.float64)), n + len(part)
            means[i] = total / n
        if short:
            flat, sizes = _bags([words[i] for i in short])
            means[short] = np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes) / sizes
        return np.where(np.fromiter(map(bool, words), bool, len(words)), means, 0.0)


def vectors(data: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets of each text and what each weighs in it: a text is a mean over its words, with BLANKS empty ones, and
    a word a mean over its features. So a text has at most BUCKETS numbers, whatever its length."""
    if len(data) == 1 and len(data[0]) > PIECE_BYTES:
        total, weight = 0, np.zeros(BUCKETS)
        for piece in pieces(data[0]):
            (n,), _, bag, part = _weights([piece])
            total += n
            weight[bag] += part
        found = np.flatnonzero(weight)
        return [(found.astype(np.int32), (weight[found] / (total + BLANKS)).astype(np.float32))]
    n, doc, bag, part = _weights(data)
    part = (part / (n + BLANKS)[doc]).astype(np.float32)
    at = np.searchsorted(doc, np.arange(1, len(data)))
    return list(zip(np.split(bag.astype(np.int32), at), np.split(part, at)))


def _weights(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """The number of words of each text, and (text, bucket, weight) with words counted and features averaged in each."""
    words, index, starts = bags(data)
    real = np.fromiter(map(bool, words), bool, len(words))
    doc, keep = np.repeat(np.arange(len(data)), np.diff(starts)), real[index]
    total = np.bincount(doc[keep], minlength=len(data))
    key, n = np.unique(doc[keep] * len(words) + index[keep], return_counts=True)
    doc, word = key // max(1, len(words)), key % max(1, len(words))
    flat, size = np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    if real.any():
        flat, size[real] = _bags([w for w in words if w])
    first, size_of = (np.cumsum(size) - size)[word], size[word]
    spot = np.repeat(first - np.cumsum(size_of) + size_of, size_of) + np.arange(size_of.sum())
    key, inverse = np.unique(np.repeat(doc, size_of) * BUCKETS + flat[spot], return_inverse=True)
    return total, key // BUCKETS, key % BUCKETS, np.bincount(inverse, np.repeat(n / np.maximum(1, size_of), size_of), len(key))


def fit(flat: np.ndarray, share: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> Model:
    """Embeddings and softmax fitted together on texts given by their buckets and weights one after another, how many each
    has, and their labels. The driver's memory is some 24 bytes for each number."""
    n_docs = len(label)
    prior = (label.sum() + 0.5) / (n_docs + 10)  # without labels nothing is called toxic
    bias0 = float(np.log(prior / (1 - prior)))
    # Features of too few documents stay zero, and so out of the sums; they still count in the means.
    kept = np.bincount(flat, minlength=BUCKETS) >= LEAST_DOCS
    ids, number = np.flatnonzero(kept), (np.cumsum(kept) - 1).astype(np.int32)
    if not len(ids) or not 0 < label.sum() < n_docs:
        return Model(np.zeros(BUCKETS, np.float32), bias0)
    use = kept[flat]
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), sizes)
    if not use.all():
        doc, flat, share = doc[use], flat[use], share[use]
    flat = number[flat]
    del use
    some, at = np.unique(doc, return_index=True)
    # The same numbers once by document and once by feature, so that both passes add up neighbours; sorted in parts.
    size = np.bincount(flat, minlength=len(ids))
    first = np.cumsum(size) - size
    doc_of, share_of = np.empty_like(doc), np.empty_like(share)
    edges = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(flat), AT_ONCE)), len(ids)])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        spot = np.flatnonzero((flat >= lo) & (flat < hi))
        spot = spot[np.argsort(flat[spot], kind="stable")]
        part = slice(first[lo], first[lo] + len(spot))
        doc_of[part], share_of[part] = doc[spot], share[spot]
    del doc
    held = np.empty(len(flat), np.float32)
    np.multiply(share_of, share_of, out=held)
    scale = 1.0 / (0.25 * np.add.reduceat(held, first).astype(np.float64) / n_docs + RIDGE)

    def sums(values: np.ndarray, at: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        values = values.astype(np.float32)
        for lo in range(0, len(at), 1 << 18):
            np.multiply(values[at[lo : lo + (1 << 18)]], weight[lo : lo + (1 << 18)], out=held[lo : lo + (1 << 18)])
        return np.add.reduceat(held, starts).astype(np.float64)

    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.01, (len(ids), DIM))
    soft = rng.normal(0, 1.0 / np.sqrt(2 * DIM), (DIM, 2))
    bias = np.array([0.0, bias0])
    speed, pace, force = np.zeros_like(table), np.zeros((DIM + 1, 2)), np.zeros((DIM + 1, 2))
    for step in range(1, STEPS + 1):
        # Forward: a document's class scores are weighted sums over its features. Of the two classes only the difference
        # is averaged, which is all that the softmax sees.
        toward = soft[:, 1] - soft[:, 0]
        odds = np.full(n_docs, bias[1] - bias[0])
        odds[some] += sums(table @ toward, flat, share, at)
        gap = (1 / (1 + np.exp(-odds)) - label) / n_docs  # of class 1; class 0 has the opposite
        # Backward through the same sums.
        to_table = sums(gap, doc_of, share_of, first)
        speed = MOMENTUM * speed - RATE * scale[:, None] * (np.outer(to_table, toward) + RIDGE * table)
        pull = np.r_[table.T @ to_table, gap.sum()][:, None] * [-1.0, 1.0]
        pace, force = 0.9 * pace + 0.1 * pull, 0.99 * force + 0.01 * pull * pull
        move = SOFT_RATE * pace / (1 - 0.9**step) / (np.sqrt(force / (1 - 0.99**step)) + 1e-12)
        table, soft, bias = table + speed, soft - move[:DIM], bias - move[DIM]
    weight = np.zeros(BUCKETS, np.float32)
    weight[ids] = table @ (soft[:, 1] - soft[:, 0])
    return Model(weight, float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the doc_id as text, modulo 4, is 2 (a null doc_id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, numbers: int = SAMPLE_NUMBERS) -> Model:
    """A model from at most `rows` labelled documents outside the held-out fold, those whose doc_id has the smallest hashes.

    Null labels don't count; of several labels of a document the largest does, of several texts of a doc_id the smallest. The
    driver gets vectors, never texts: at most `numbers` of their numbers, of so many documents in the same order.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # a broadcast of at most `rows` narrow rows
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            found = vectors(texts(batch))
            bag, weight = (pa.array([f[i].astype(t).tobytes() for f in found], pa.binary()) for i, t in enumerate(("<i4", "<f4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), bag, weight], names=["doc_id", "toxic", "bag", "weight"])

    ship(docs.sparkSession)
    toxic = f"toxic {known.schema['toxic'].dataType.simpleString()}"
    made = materialise(sample.mapInArrow(run, f"doc_id long, {toxic}, bag binary, weight binary"))
    order = made.select(F.xxhash64("doc_id").alias("h"), "doc_id", (F.octet_length("bag") / 4).cast("long").alias("n")).orderBy("h", "doc_id")
    total, count = 0, 0
    for h, doc_id, n in order.toLocalIterator():
        if total + n > numbers:
            made = made.where((F.xxhash64("doc_id") < h) | (F.xxhash64("doc_id") == h) & (F.col("doc_id") < doc_id))
            break
        total, count = total + n, count + 1
    return fit(*_gathered(made, total, count))


def _gathered(made: DataFrame, total: int, count: int) -> tuple[np.ndarray, ...]:
    """The arguments of `fit`. Vectors come partition by partition into arrays of known size, so neither the JVM nor Python
    holds them twice, and only `fit` keeps them."""
    flat, share = np.empty(total, np.int32), np.empty(total, np.float32)
    sizes, label, at = np.zeros(count, np.int64), np.zeros(count), 0
    for i, (toxic, bag, weight) in enumerate(made.orderBy(F.xxhash64("doc_id"), "doc_id").select("toxic", "bag", "weight").toLocalIterator()):
        n = len(bag) // 4
        sizes[i], label[i] = n, int(toxic > 0)
        flat[at : at + n], share[at : at + n] = np.frombuffer(bag, "<i4"), np.frombuffer(weight, "<f4")
        at += n
    release_memory()
    return flat, share, sizes, label


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, Recent(CACHE)

    def _sums(self, data: list[bytes]) -> np.ndarray:
        """(sum of word scores, number of words) of each text."""
        if len(data) == 1 and len(data[0]) > PIECE_BYTES:
            return sum(self._some([p]) for p in pieces(data[0]))
        return self._some(data)

    def _some(self, data: list[bytes]) -> np.ndarray:
        """The same of texts of any length, all at once."""
        found, index, starts = bags(data)
        missing = list(self.known.missing(set(found)))
        self.known.update(zip(missing, self.model.words(missing).tolist()))
        score = np.fromiter(map(self.known.__getitem__, found), np.float64, len(found))
        real = np.fromiter(map(bool, found), np.float64, len(found))
        return np.stack([np.diff(np.r_[0, np.cumsum(x[index])][starts]) for x in (score, real)], 1)

    def scores(self, data: list[bytes]) -> np.ndarray:
        sums = self._sums(data)
        return 1 / (1 + np.exp(-(sums[:, 0] / (sums[:, 1] + BLANKS) + self.model.bias)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher is more toxic), predicted (score >= threshold).

    A null or empty text, or one without letters, gets the score of the bias. Null doc_ids and repeated rows are scored
    like any row; other columns are not read; an empty table gives an empty result. One Arrow pass over whole texts with
    the bucket weights broadcast (their number is fixed).
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = Scorer(shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(texts(batch)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`score` by a model that `train` fits on the labelled part of the same documents."""
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score below the threshold: judged and filtered in one pass, without a join."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = Scorer(shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(own.scores(texts(batch)) < threshold))

    return docs.mapInArrow(run, docs.schema)
