"""Vectorised text kernels on Arrow string buffers (numpy, no per-word Python).

A batch is cut into slices of at most ``SLICE_BYTES`` bytes of text (a longer
text is a slice of its own), so memory follows the largest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 2 << 20
#: Powers that are held at least; longer slices take theirs.
_LEAST = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes outside every given inclusive range."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words are runs of anything but space, tab, line feed, VT, FF, CR.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)) | np.isin(np.arange(256), np.arange(65, 91))


def any_names(function):
    """For functions of a DataFrame that go through Arrow by column name: names with dots or backticks are put aside and given back."""

    @wraps(function)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        odd = {c: f"_odd_{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
        if not odd:
            return function(df, *args, **options)
        named = {new: c for c, new in odd.items()}
        put = lambda x: odd.get(x, x) if isinstance(x, str) else x
        out = function(df.toDF(*map(put, df.columns)), *map(put, args), **{k: put(v) for k, v in options.items()})
        return out.toDF(*(named.get(c, c) for c in out.columns))

    return run


def trimmed(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of batches that gives freed memory back to the system when its task ends: workers outlive tasks and wait for the next beside others."""

    @wraps(task)
    def run(*args) -> Iterator:
        try:
            yield from task(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not the GNU C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of ``batch`` holding about ``limit`` bytes of text."""
    text = batch.column(column)
    lengths = np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words per text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    mask = is_word[raw]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    filled = offsets[1:] > offsets[:-1]
    edge = offsets[:-1][filled]
    first[edge] = mask[edge]
    edge = offsets[1:][filled] - 1
    last[edge] = mask[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(bounds)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n + 1, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, ASCII case folded: a polynomial in the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = max(_LEAST, 1 << int(len(raw) - 1).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[LOWER[raw]] * up[: len(raw)], out=total[1:])
        found = (total[ends] - total[starts]) * down[starts]
        return mix(found + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the word hashes from ``starts`` up to ``ends``: a polynomial in them."""
    up, down = _powers(max(_LEAST, 1 << int(len(words)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word windows, text after text, and windows per text.

    A text of fewer words, but not none, has its whole sequence as one window.
    """
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1)).astype(np.int64)
    with np.errstate(over="ignore"):
        n = len(words)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled[: max(0, n - k)] = rolled[: max(0, n - k)] * _SHINGLE_BASE + words[k:]
        position = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(made.sum())
        out = mix(rolled[position])
        starts = np.concatenate([[0], np.cumsum(made)[:-1]]).astype(np.int64)
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            value = np.uint64(counts[i])
            for w in words[bounds[i] : bounds[i + 1]]:
                value = value * _SHINGLE_BASE + w
            out[starts[i]] = mix(np.array([value ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64))[0]
    return out, made
