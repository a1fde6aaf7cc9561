"""Exact deduplication: group by a 128-bit content hash, keep one row, compare bytes inside the groups."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from tessera.llm.batches import WHITE, slices, texts
from tessera.scratch import materialise, row_keys, without_rows

#: Bits of the filter that tells which texts to read again: BITS_PER_GROUP for each group of two or more, between these
#: bounds (powers of two; 8 KB to 512 MB). Beyond the greatest, some 2 * 10^8 groups, false alarms grow, never misses.
LEAST_BITS, MOST_BITS, BITS_PER_GROUP = 16, 32, 16
BUCKET = 32768  # bits in one bitmap of Spark's bitmap_construct_agg


def content_hash(normalised: bytes) -> bytes:
    return hashlib.md5(normalised, usedforsecurity=False).digest()


def _place(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=4).digest(), "little")


def _digests(hash128: Callable[[bytes], bytes], keys: list[str], bits=None):
    """Narrow rows of all texts or, given the bits of a filter, the rows it lets through with their normalised texts."""
    owned = ["doc_id", *keys]

    def run(batches):
        wanted = None if bits is None else np.frombuffer(bits.value, np.uint8)
        mask = 0 if wanted is None else 8 * len(wanted) - 1
        for batch in slices(batches):
            raw = texts(batch)
            bare = [t.translate(None, WHITE) for t in raw]
            content = [hash128(t) for t in bare]
            ids = [batch.column(c) for c in owned]
            at = [_place(c) for c in content]
            if wanted is not None:
                hit = [i for i, p in enumerate(at) if wanted[(p & mask) >> 3] >> (p & 7) & 1]
                raw, bare, content, at = ([x[i] for i in hit] for x in (raw, bare, content, at))
                ids = [c.take(pa.array(hit, pa.int64())) for c in ids]
            columns = [
                *ids,
                pa.array([len(t.decode("utf-8", "replace")) for t in raw], pa.int64()),
                pa.array(content, pa.binary()),
                pa.array([hashlib.sha256(t).hexdigest() for t in bare], pa.string()),
                pa.array(at, pa.int64()) if wanted is None else pa.array(bare, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*owned, "points", "content", "text_sha256", "place" if wanted is None else "bare"])

    return run


def _filter_of(rows: DataFrame):
    """Broadcast bits at the places of these rows, BITS_PER_GROUP for each, up to 2^MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_GROUP * rows.count()).bit_length()))
    place = F.col("place").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    found = rows.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    held = bytearray(1 << (bits - 3))
    for bucket, bitmap in found.toLocalIterator():  # bucket 1 holds the values 1 to BUCKET, which stand for the places 0 to BUCKET - 1
        first = (bucket - 1) * BUCKET // 8
        held[first : first + len(bitmap)] = bytes(bitmap)
    return rows.sparkSession.sparkContext.broadcast(bytes(held))


def exact_duplicates(docs: DataFrame, hash128: Callable[[bytes], bytes] = content_hash, keys: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; a null text counts as empty. Of equal texts the row
    with most code points in the original text stays, then the smallest doc_id; a null doc_id loses every tie. `keys` name
    long columns that tell rows apart (`scratch.row_keys`): they are returned too, break the remaining ties, and exactly one
    row of a group is kept. Without them rows that repeat both the doc_id and the length of the row that stays are all
    marked kept, since nothing tells them apart. Other columns are not read. An empty table gives an empty result.

    Plan: one Arrow pass hashes whole texts to narrow rows, which are written once. Groups come from a partial aggregate,
    so a group with a third of the rows costs one row per task. A second pass reads again only texts of groups of two or
    more (through a filter sized by their number) and compares bytes as min(text) = max(text) per group, again a partial
    aggregate. Groups in which a byte differs, that is hash collisions, are keyed by the normalised text itself.
    """
    keys, spark = keys or [], docs.sparkSession
    docs = docs.select("doc_id", "text", *keys)
    own = ", ".join(f"{k} long" for k in ("doc_id", *keys))
    narrow = f"{own}, points long, content binary, text_sha256 string"
    rows = materialise(docs.mapInArrow(_digests(hash128, keys), f"{narrow}, place long"))
    # ~ turns the order of ids around
    best = F.max(F.struct("points", *(F.expr(f"~{k}").alias(f"b{i}") for i, k in enumerate(("doc_id", *keys))))).alias("best")
    kept_keys = [f"keep_{k}" for k in keys]
    keeper = [F.expr("~best.b0").alias("keep_id"), *(F.expr(f"~best.b{i}").alias(k) for i, k in enumerate(kept_keys, 1)), F.col("best.points").alias("keep_points"), "group_size"]
    size = F.count(F.lit(1)).alias("group_size")
    groups = materialise(rows.groupBy("content").agg(best, size, F.first("place").alias("place")).select("content", "place", *keeper))

    def again(which: DataFrame) -> DataFrame:
        return docs.mapInArrow(_digests(hash128, keys, _filter_of(which)), f"{narrow}, bare binary")

    inside = again(groups.where("group_size > 1")).groupBy("content").agg(F.min("bare").alias("low"), F.max("bare").alias("high"))
    clash = materialise(inside.where("low <> high").select("content"))

    def answer(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
        for k, keep in zip(keys, kept_keys):
            kept = kept & (F.col(k) == F.col(keep))
        return rows.join(groups, by).select("doc_id", *keys, "keep_id", "group_size", kept.alias("kept"), "text_sha256")

    if clash.isEmpty():
        return answer(rows.drop("place"), groups.drop("place"), ["content"])
    odd = again(groups.join(clash, "content", "left_semi")).join(clash, "content", "left_semi")
    fine = odd.groupBy("content", "bare").agg(best, size).select("content", "bare", *keeper)
    whole = answer(rows.drop("place").join(clash, "content", "left_anti"), groups.drop("place"), ["content"])
    return whole.unionByName(answer(odd, fine, ["content", "bare"]))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, but of equal texts only the one that `exact_duplicates` keeps, whatever their doc_ids."""
    docs, keys = row_keys(docs)
    return without_rows(docs, exact_duplicates(docs, keys=keys).where("not kept"), keys)
