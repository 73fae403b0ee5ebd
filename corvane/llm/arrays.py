"""Vectorised text work on Arrow batches: whole buffers at a time, no loop over characters or words.

A *word* is a maximal run of bytes other than ASCII punctuation, white space and control characters, so every
non-ASCII character is part of a word; the same rule in SQL is split(lower(text), '[^0-9a-z\\x80-...]+').
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE_KEY = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD) | np.uint64(1)
_POS_KEY = mix(np.arange(1000, 1000 + 4096, dtype=np.uint64) * _GOLD) | np.uint64(1)


def _position_keys(n: int) -> np.ndarray:
    return _POS_KEY[:n] if n <= len(_POS_KEY) else mix(np.arange(1000, 1000 + n, dtype=np.uint64) * _GOLD) | np.uint64(1)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array of 64-bit offsets without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_string())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their n + 1 offsets) of a plain() array, starting at 0."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def chunks(batches: Iterator[pa.RecordBatch], text: str, target: int) -> Iterator[pa.Table]:
    """Tables of about `target` bytes of text each, splitting or joining batches between rows, never within a text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64)
        start = 0
        ends = np.cumsum(lengths)
        while start < len(lengths):
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + target - size, "left")) + 1
            stop = min(max(stop, start + 1), len(lengths))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - base)
            start = stop
            if size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    held = []
    released()


def released() -> None:
    """Give memory that this Python process no longer uses back to the system: workers are kept for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def spans(raw: np.ndarray, offsets: np.ndarray, is_in: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, text index) of each maximal run of bytes with is_in that lies within one text."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_in[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that aren't empty
    first[begin] = inside[begin]
    last[begin[1:] - 1] = inside[begin[1:] - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(offsets, s, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes. Spans don't overlap and are in order."""
    length = end - start
    out, ends = np.zeros(len(start), np.uint64), np.cumsum(length)
    i = 0
    while i < len(start):  # in blocks of about half a megabyte: eight bytes are needed several times for each byte
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 19), "right")))
        out[i:j] = _span_hashes(raw, start[i:j], length[i:j])
        i = j
    return out


def _span_hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    at = np.arange(ends[-1], dtype=np.int64)
    begin = ends - length
    shift = np.repeat(begin, length)
    at -= shift  # position within the span
    keys = _position_keys(int(length.max()))
    value = _BYTE_KEY[raw[at + np.repeat(start, length)]] * keys[at]
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, first byte, end byte in the original text's buffer) of every word; hashes ignore case."""
    raw, offsets = buffers(column)
    start, end, doc = spans(raw, offsets)
    low_raw, low_offsets = buffers(lower(column))
    ls, le, _ = spans(low_raw, low_offsets)
    if len(ls) != len(start):  # lower() made or took a separator; hash the texts as they are
        ls, le, low_raw = start, end, raw
    return span_hashes(low_raw, ls, le), doc, start, end


def counts_by(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array whose i-th list holds the next counts[i] values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(start - (ends - count), count)
