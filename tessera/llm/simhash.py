"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, Window

from tessera.llm.batches import pieces, slices, texts
from tessera.llm.components import components
from tessera.scratch import materialise, row_keys, without_rows

SEED = 42
SHINGLE = 3
#: A-Z to a-z, byte by byte; bytes of longer UTF-8 sequences stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: _SPREAD[b] holds bit k of b in its k-th byte, so that adding up to 255 such words counts eight bits at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of n words, repeats included; of the whole word sequence if shorter; none if empty."""
    parts, last, total, digest = [], [], 0, xxhash.xxh64_intdigest
    for piece in pieces(text):
        words = piece.translate(LOWER).split()
        total += len(words)
        words = last + words
        if len(words) >= n:
            grams = map(b" ".join, zip(*(words[i:] for i in range(n))))
            parts.append(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(words) - n + 1))
        last = words[max(0, len(words) - n + 1) :]
    if 0 < total < n:
        return np.array([digest(b" ".join(last), SEED)], np.uint64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint (uint64) for each array: a bit is 1 if set in over half the hashes; zero for none."""
    out = np.zeros(len(hashes), np.uint64)
    for i, h in enumerate(hashes):
        if not len(h):
            continue
        counts = np.zeros(64, np.int64)
        for lo in range(0, len(h), 255 * 256):
            lanes = _SPREAD[h[lo : lo + 255 * 256].astype("<u8").view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
            counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def _fingerprint_rows(n: int, names: list[str]):
    def run(batches):
        for batch in slices(batches):
            prints = fingerprints([shingle_hashes(t, n) for t in texts(batch)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prints.view(np.int64))], names=[*names, "fp"])

    return run


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = SHINGLE, keys: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    `keys` name long columns that tell rows apart (`scratch.row_keys`); they are returned too, with `first`: true for
    exactly one row of each component, that of the smallest doc_id (null last), then keys.

    Fingerprints at `radius` (even) or fewer differing bits are linked; component_id is the smallest doc_id reachable.
    A null or empty text has fingerprint zero and is linked like any other. Null doc_ids take part but never name a
    component unless it has no other id. Repeated rows and ties are copies: they share a component. Columns other than
    doc_id and text are not read; an empty table gives an empty result.

    Plan: whole texts become narrow (doc_id, fp) rows in one Arrow pass. Only distinct fingerprints go on, so copies cost
    nothing. Each emits its ball of half the radius (65 variants at radius 2); two fingerprints within the radius share a
    variant. All members of a variant are pairwise within the radius, and there are at most 65 of them by construction,
    so linking neighbours in sorted order keeps the component whole without emitting pairs of a group. Links are
    deduplicated and verified, then contracted to components.
    """
    if radius % 2:
        raise ValueError("the radius is met in the middle, so it must be even")
    names = ["doc_id", *(keys or [])]
    schema = ", ".join(f"{c} long" for c in (*names, "fp"))
    rows = materialise(docs.select(*names, "text").mapInArrow(_fingerprint_rows(shingle, names), schema))
    return component_rows(rows, radius, keys)


def component_rows(rows: DataFrame, radius: int = 2, keys: list[str] | None = None) -> DataFrame:
    """The same from ready (doc_id, keys, fp long) rows."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys) if keys else F.col("doc_id")
    prints = rows.groupBy("fp").agg(F.min(first).alias("first_id"))
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    assert len(masks) == sum(comb(64, k) for k in range(radius // 2 + 1))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    ball = prints.select("fp", F.explode(F.array([F.col("fp").bitwiseXOR(F.lit(m)) for m in signed])).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    links = ball.select(F.col("fp").alias("b"), before.alias("a")).where("a is not null").distinct()
    links = links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    roots = components(links)
    whole = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    names = whole.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(whole.join(names, "root").select("fp", "component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if not keys:
        return rows.join(named, "fp").select("doc_id", text, "component_id")
    mine = [F.col(k) == F.col(f"component_id.{k}") for k in keys]
    return rows.join(named, "fp").select("doc_id", *keys, text, F.col("component_id.doc_id").alias("component_id"), reduce(Column.__and__, mine).alias("first"))


def drop_near_copies(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of `docs`, all columns, but of each component only the first one, whatever their doc_ids."""
    docs, keys = row_keys(docs)
    return without_rows(docs, near_duplicates(docs, radius, keys=keys).where("not first"), keys)
