"""Words of Arrow text batches as numpy arrays: boundaries, hashes, window hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is the same as a run of
such characters because all other bytes of UTF-8 are above 0x7F or printable. A null text has
no words. Texts are handled in chunks of about ``CHUNK_BYTES``; a longer text is a chunk of its
own, so the memory of a task is bounded by the longest single text, never by the table. Inside a
chunk, bytes are looked at ``BLOCK_BYTES`` at a time: what stays is three numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .tables import ship

CHUNK_BYTES = 1 << 19
BLOCK_BYTES, _BLOCK_WORDS = 1 << 18, 1 << 15
#: Longer words are hashed in pieces of this many bytes.
_PIECE = 1 << 12
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For looser matching: ASCII signs part words too.
SIGNS = np.zeros(256, dtype=bool)
SIGNS[[b for b in range(0x80) if not chr(b).isalnum()]] = True
_PLAIN = _byte_values()
_LOWER = _PLAIN.copy()
_LOWER[ord("A"):ord("Z") + 1] = _PLAIN[ord("a"):ord("z") + 1]


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_PIECE_POWERS = _powers(_BASE, _PIECE)


class Texts(NamedTuple):
    """UTF-8 bytes of consecutive texts; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """One entry per word; ``first`` has, for each text, the index of its first word."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def as_texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    base, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    data = np.frombuffer(data, dtype=np.uint8)[base:last] if last > base else np.zeros(0, np.uint8)
    return Texts(data, offsets - base if len(column) else np.zeros(1, np.int64))


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that a piece has about ``size`` bytes of text."""
    if not batch.num_rows:
        return
    lengths = np.diff(as_texts(batch.column(text)).offsets)
    piece = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def find_words(texts: Texts, breaks: np.ndarray = _SPACE) -> Words:
    data, offsets = texts
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data), BLOCK_BYTES):
        # One byte more on each side, which shows where a word goes on.
        lo, hi = max(at - 1, 0), min(at + BLOCK_BYTES + 1, len(data))
        inside = ~breaks[data[lo:hi]]
        edge = np.zeros(hi - lo + 1, dtype=bool)
        edge[offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, side="right")] - lo] = True
        goes_on = inside[1:] & inside[:-1] & ~edge[1:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~goes_on
        last[:-1] &= ~goes_on
        own = slice(at - lo, min(at + BLOCK_BYTES, len(data)) - lo)
        starts.append(np.flatnonzero(first[own]) + at)
        ends.append(np.flatnonzero(last[own]) + at + 1)
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.searchsorted(start, offsets))


def span_hashes(texts: Texts, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A-Z count as a-z. Words are not empty."""
    out = np.empty(len(start), dtype=np.uint64)
    values = _LOWER if lower else _PLAIN
    for a in range(0, len(start), _BLOCK_WORDS):
        out[a:a + _BLOCK_WORDS] = _word_hashes(texts.data, start[a:a + _BLOCK_WORDS], end[a:a + _BLOCK_WORDS], values)
    return out


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    sizes = end - start
    # A word is one piece or more, in places of its own.
    pieces = -(-sizes // _PIECE)
    number = ranges(np.zeros_like(pieces), pieces)
    at = np.repeat(start, pieces) + number * _PIECE
    length = np.minimum(np.repeat(end, pieces) - at, _PIECE)
    raw = np.empty(len(at), dtype=np.uint64)
    block = np.cumsum(length) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(at)]
    for a, b in zip(cuts, cuts[1:]):
        size = length[a:b]
        spread = values[data[ranges(at[a:b], size)]]
        spread *= _PIECE_POWERS[ranges(np.zeros_like(size), size)]
        raw[a:b] = np.add.reduceat(spread, np.cumsum(size) - size)
    if len(at) > len(start):
        raw *= _powers(pow(_BASE, _PIECE, 1 << 64), int(pieces.max()))[number]
    return mix(np.add.reduceat(raw, np.cumsum(pieces) - pieces) + sizes.astype(np.uint64) * _GOLDEN)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` consecutive entries; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    # Runs of 1, 2, 4, ... entries; those in the binary form of the width, one after the other.
    run, size, done, out = hashes, 1, 0, np.zeros(n, dtype=np.uint64)
    while True:
        if width & size:
            out *= np.uint64(pow(_BASE, size, 1 << 64))
            out += run[done:done + n]
            done += size
        if 2 * size > width:
            return mix(out)
        run = run[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + run[size:]
        size *= 2


def owners(first: np.ndarray) -> np.ndarray:
    """The index of its text for each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(skip - starts, counts)


ship(__name__)
