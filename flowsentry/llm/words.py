"""Words of whole Arrow text columns as numpy arrays: where they are and 64-bit hashes of them.

Separators are ASCII, so UTF-8 bytes can be cut without decoding. Callers work through a column in
slices of a few MB (row_slices), which bounds memory whatever the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

#: True for the bytes of words.
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: The same, with ASCII punctuation and control bytes as separators too.
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the n + 1 offsets of the texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, in place."""
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= _M1
    x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    h = mix((length.astype(np.uint64) + np.uint64(1)) * _M2)
    h = mix(h ^ (eight[start] & _MASK[np.minimum(length, 8)]))
    todo, done = np.flatnonzero(length > 8), 8
    while len(todo):
        if done >= 512:  # few and long
            raw = memoryview(padded)
            for i in todo:
                h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]])
            break
        rest = length[todo] - done
        h[todo] = mix(h[todo] ^ (eight[start[todo] + done] & _MASK[np.minimum(rest, 8)]))
        todo, done = todo[rest > 8], done + 8
    return h


@dataclass
class Words:
    """Words of the texts of one slice, in order; row_end: for each text the index after its last word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    row_end: np.ndarray

    @property
    def row_start(self) -> np.ndarray:
        return np.concatenate([[0], self.row_end[:-1]]).astype(np.int64)

    def count(self) -> np.ndarray:
        return self.row_end - self.row_start


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = PLAIN) -> Words:
    """The words of each text; offsets count from the start of data."""
    word = inside[data]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    row_end = np.searchsorted(start, offsets[1:])
    row = np.repeat(np.arange(len(row_end)), np.diff(row_end, prepend=0))
    return Words(start, end, row, row_end)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M2
    x += b
    x ^= x >> np.uint64(29)
    x *= _M1
    return x


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` neighbouring hashes (texts are not kept apart here)."""
    n = max(0, len(h) - size + 1)
    out, done, power, width = None, 0, h, 1
    while size:
        if size & 1:
            out = power[:n].copy() if out is None else _joined(out[:n], power[done : done + n])
            done += width
        size >>= 1
        if size:
            power = _joined(power[:-width], power[width:]) if len(power) > width else power[:0]
            width *= 2
    return mix(out[:n])


def sliding(op, values: np.ndarray, size: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every run of `size` neighbours."""
    n = max(0, len(values) - size + 1)
    if not n:
        return values[:0]
    width, power = 1, values
    while width * 2 <= size:
        power = op(power[:-width], power[width:])
        width *= 2
    return op(power[:n], power[size - width : size - width + n])


def word_slices(column: pa.Array, limit: int, inside: np.ndarray = PLAIN, lower: bool = False) -> Iterator[tuple[int, np.ndarray, Words]]:
    """For each slice of rows: the first row, the hashes of its words and the words."""
    raw, offsets = text_bytes(column)
    for first, last in row_slices(offsets, limit):
        data = raw[offsets[first] : offsets[last]]
        data = LOWER[data] if lower else data
        found = find_words(data, offsets[first : last + 1] - offsets[first], inside)
        yield first, span_hashes(data, found.start, found.end), found
