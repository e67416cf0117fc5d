"""Arrow helpers shared by the text operators: bounded slices of text, raw UTF-8 views, ragged gathers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step holds at once (a single longer text is a slice of its own).
SLICE_BYTES = 4 << 20


#: What this worker process holds between tasks, as functions that let go of it.
held: list[Callable[[], None]] = []


def give_back(caches: bool = True) -> None:
    """Return memory that this worker doesn't need now: unused pages, and caches of other operators."""
    while caches and held:
        held.pop()()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, keep: bool = False) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Cut batches into runs of rows holding about ``limit`` bytes of ``text``; null texts become empty.

    Workers serve task after task: one that doesn't ``keep`` the caches of tokenisers frees them first.
    """
    give_back(not keep)
    yield from _slices(batches, limit)
    give_back(False)


def _slices(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column("text"), "")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at), text.slice(at, stop - at)
            at = stop


def raw_utf8(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and n + 1 offsets that start at 0."""
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]


def spans_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
