"""Arrow string columns as byte arrays: words, hashes and ragged joins without a Python loop per word.

A text is read as UTF-8. Words and lines are cut at ASCII bytes only, so no
code point is ever split. Hashes are polynomial over bytes (or over the hashes
of words), taken from prefix sums modulo 2**64, and mixed afterwards; equal
texts always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def column(values) -> pa.Array:
    """A plain string array of a batch's column."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(pa.large_string())


def slices(texts: pa.Array, most: int = SLICE_BYTES, unit: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes); null is an empty text, ``unit`` rows stay together."""
    texts = column(texts)
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(ends, ends[low] + most, "right")) - 1
        high = min(n, max(high // unit * unit, low + unit))
        yield low, high, whole[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of marked bytes; no run crosses a row's border."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = offsets[(offsets > 0) & (offsets < n)]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, rows."""
    return runs(~WHITE[data], offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    n = len(data)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(value ^ (ends - starts).astype(U64) * U64(0xE7037ED1A0B428DB) ^ U64(salt))


def grams(values: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive values of one row, and the first position of each."""
    n = len(values)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * power[:n], out=sums[1:])
    at = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
    return mix((sums[at + k] - sums[at]) * inverse[at] ^ U64(k)), at


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of these lengths: the row of each element and its place in the row."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    before = np.cumsum(lengths) - lengths
    return rows, np.arange(len(rows)) - before[rows]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ragged slices of an array, one after another."""
    rows, place = spread(lengths)
    return values[starts[rows] + place]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """Byte ranges as Python strings."""
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())]


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Counts by row."""
    return np.bincount(rows, minlength=n).astype(np.int64)


def binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Ragged rows of a numeric array as a binary column."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * values.dtype.itemsize, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def batches(fields: dict[str, pa.DataType], parts: dict[str, list]) -> pa.RecordBatch:
    """One record batch of columns that were gathered slice by slice."""
    columns = []
    for name, kind in fields.items():
        got = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in parts[name]]
        one = pa.concat_arrays([x.cast(kind) for x in got]) if got else pa.array([], kind)
        columns.append(one)
    return pa.RecordBatch.from_arrays(columns, list(fields))
