"""Array views of text columns: words, hashes and n-grams of whole batches without Python loops."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first bytes of eight.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``most`` bytes in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    got = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space, or without bytes ``outside``) and, for each row, its first word.

    The third array has one more entry than there are rows, like ``offsets``.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~outside[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans, in order and without overlaps, as an Arrow array."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] = 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


class SpanHash:
    """64-bit hashes of byte spans and of runs of consecutive values; the seed chooses the function.

    A span is read in words of eight bytes, each mixed into the hash before the next, so no pattern of
    bytes cancels out as it can in a polynomial modulo a power of two. Runs are hashed by doubling.
    """

    #: Longer spans are hashed one by one.
    LONG = 512

    def __init__(self, seed: int):
        self.seed, *self.odd = (int(x) | 1 for x in np.random.default_rng(seed).integers(0, 1 << 63, 3))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        size = np.asarray(ends, np.int64) - starts
        out = mixed((size.astype(np.uint64) + np.uint64(1)) * np.uint64(self.seed))
        if not len(size):
            return out
        held = np.zeros(len(data) + 8, np.uint8)
        held[: len(data)] = data
        eight = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
        most = int(size.max())
        live, at, left = None, np.asarray(starts, np.int64), size
        for k in range(0, min(most, self.LONG), 8):
            if live is None and k:
                live = np.flatnonzero(size > 8)
                at, left = at[live], left[live]
            elif k:
                on = left > 8
                live, at, left = live[on], at[on], left[on]
            if k:
                at, left = at + 8, left - 8
            chunk = eight[at] & _KEEP[np.minimum(left, 8)]
            if live is None:
                out = mixed(out ^ chunk * np.uint64(self.odd[0]))
            else:
                out[live] = mixed(out[live] ^ chunk * np.uint64(self.odd[0]))
        if most > self.LONG:
            raw = data.tobytes()
            for i in np.flatnonzero(size > self.LONG):
                a, b = int(starts[i]), int(starts[i] + size[i])
                digest = hashlib.blake2b(raw[a:b], digest_size=8, key=self.seed.to_bytes(8, "little"))
                out[i] = int.from_bytes(digest.digest(), "little")
        return out

    def runs(self, values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of ``size`` consecutive values from each start; ``values`` are hashes already."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        one, two = (np.uint64(x) for x in self.odd)
        power, width, out, done = values, 1, None, 0
        while True:
            if size & width:
                part = power[starts + done]
                out = mixed(part * one + two) if out is None else mixed(out * one + part)
                done += width
            if done == size:
                return out
            # Positions near the end have no full run, and no start asks for one.
            power = mixed(power[:-width] * two + power[width:]) if len(power) > width else power
            width *= 2


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all windows of ``size`` words inside one row each, and the row of each.

    ``first`` is the third result of ``word_spans``.
    """
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return ranges(first[:-1], count), row


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... with counts[i] numbers for each i."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
