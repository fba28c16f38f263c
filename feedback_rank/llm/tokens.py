"""Words of whole texts as numpy arrays, straight from Arrow's buffers.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, with A to Z
lower-cased. Everything here works on the bytes of many texts at once; no Python
object is made for a text or a word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 2_000_000  # texts are worked on in slices of about this size, a longer text in one slice of its own
BATCH_ROWS = 2_000       # rows, and bytes, that tasks hand to Python at once
BATCH_BYTES = 8 << 20
_WINDOW = 1 << 20        # bytes hashed at once

# an odd base and its inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose tasks hand rows to Python by BATCH_ROWS and BATCH_BYTES at most.

    Whole texts are long, and a task holds a batch in several forms at once. The settings are
    the session's: they stay, and smaller ones of its own are left as they are.
    """
    conf, prefix = df.sparkSession.conf, "spark.sql.execution.arrow"
    for name, most in ((f"{prefix}.maxRecordsPerBatch", BATCH_ROWS), (f"{prefix}.maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(name, str(most))
    return df


def give_back() -> None:
    """Hand the memory that this Python worker has freed to the system: it waits for its next task, maybe one of another stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run: Callable, *args) -> Callable:
    """``run(batches, *args)`` for a task whose worker keeps no memory that it does not use, before and after."""

    def task(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from run(batches, *args)
        finally:
            give_back()

    return task


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _BACK = _powers(_BASE, _WINDOW + 1), _powers(_INVERSE, _WINDOW + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every range, one range after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


class Words:
    """The words of a few texts: where they lie in ``data``, and which text has which of them.

    ``data`` are the lower-cased bytes, ``starts`` and ``ends`` the words' places in
    them; text i has the words from ``bounds[i]`` to ``bounds[i + 1]``.
    """

    def __init__(self, data: np.ndarray, text_bounds: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        inside = _IN_WORD[data]
        begins, stops = inside.copy(), inside.copy()
        edges = text_bounds[:-1][text_bounds[:-1] < len(data)]
        begins[1:] &= ~inside[:-1]
        begins[edges] = inside[edges]
        stops[:-1] &= ~inside[1:]
        last = text_bounds[1:] - 1
        last = last[last >= 0]
        stops[last] = inside[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, text_bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            upto = int(np.searchsorted(self.ends, base + _WINDOW, side="right"))
            if upto <= at:  # one word longer than a window: by its windows, one after the other
                out[at] = self._long(int(base), int(self.ends[at]))
                at += 1
                continue
            window = self.data[base:self.ends[upto - 1]]
            sums = np.empty(len(window) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum((window.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(window)], out=sums[1:])
            first, stop = self.starts[at:upto] - base, self.ends[at:upto] - base
            out[at:upto] = (sums[stop] - sums[first]) * _BACK[first]
            at = upto
        return mixed(out + (self.ends - self.starts).astype(np.uint64) * np.uint64(_BASE))

    def _long(self, start: int, end: int) -> np.uint64:
        total = 0
        for at in range(start, end, _WINDOW):
            part = self.data[at:min(end, at + _WINDOW)].astype(np.uint64) + np.uint64(1)
            total += int((part * _POWERS[:len(part)]).sum()) * pow(_BASE, at - start, 1 << 64)
        return np.uint64(total % (1 << 64))


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds of the rows' texts) by slices of about ``size`` bytes.

    A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    if column.null_count:  # what lies under a null is not defined
        empty = column.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[empty] > 0).any():
            yield from text_slices(column.fill_null(""), size)
            return
    first = 0
    while first < len(column):
        upto = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        upto = min(upto, len(column))
        yield first, upto, data[offsets[first]:offsets[upto]], offsets[first:upto + 1] - offsets[first]
        first = upto
    # Arrow's pool keeps what batches before this one took, and a worker lives for many tasks
    pa.default_memory_pool().release_unused()


def word_slices(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) by slices of SLICE_BYTES."""
    for first, upto, data, bounds in text_slices(column):
        yield first, upto, Words(data, bounds, lower)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all runs of ``size`` words of each text, in order.

    A text of fewer words, but at least one, has all its words as one run. Runs of
    different length are told apart.
    """
    counts = np.diff(bounds)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(per_text)])
    starts = ragged(bounds[:-1], per_text)
    short = np.repeat(counts < size, per_text)
    out = np.zeros(len(starts), dtype=np.uint64)
    full = starts[~short]
    run = np.full(len(full), size, dtype=np.uint64)
    for i in range(size):
        run = run * np.uint64(_BASE) + hashes[full + i]
        run ^= run >> np.uint64(29)
    out[~short] = mixed(run)
    for place, start in zip(np.flatnonzero(short), starts[short]):
        n = int(counts[np.searchsorted(out_bounds, place, side="right") - 1])
        with np.errstate(over="ignore"):
            one = np.full(1, n, dtype=np.uint64)
            for i in range(n):
                one = one * np.uint64(_BASE) + hashes[start + i]
                one ^= one >> np.uint64(29)
            out[place] = mixed(one)[0]
    return out, out_bounds
