"""Arrow plumbing of the Python operators: bounded slices of whole rows, whatever the length of the texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds; a single longer text forms a slice of its own.
SLICE_BYTES = 8 << 20
#: Bytes of a text whose words are in memory at once.
PIECE_BYTES = 1 << 20
try:  # glibc keeps freed blocks otherwise
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def release_memory() -> None:
    """Give freed memory back: workers live on after a task and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
        release_memory()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def pieces(data: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in order, cut before white space, so that a very long text is never split into words all at once."""
    at = 0
    while len(data) - at > limit:
        end = at + limit
        while end < len(data) and not (data[end] in WHITE and data[end - 1] not in WHITE):
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


class Recent(dict):
    """A bounded cache in two generations: entries used since the last turn survive it, so rare words pass through.

    After `missing(keys)` and an update with what it returns, every one of `keys` is in the mapping.
    """

    def __init__(self, limit: int):
        self.limit, self.old = limit // 2, {}

    def missing(self, keys: set) -> set:
        gone = keys.difference(self)
        if len(self) + len(gone) > self.limit:
            self.old = dict(self)
            self.clear()
            gone = keys
        back = gone.intersection(self.old)
        self.update(zip(back, map(self.old.__getitem__, back)))
        return gone.difference(back)
