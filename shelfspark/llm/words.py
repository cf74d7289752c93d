"""Word splitting and hashing of whole Arrow text batches with numpy.

These helpers run inside Spark tasks.  They work on the UTF-8 bytes of a batch
at once: separators are ASCII, so splitting bytes equals splitting characters.
A span's hash is a polynomial over a random value per byte, taken from one
running sum, so any number of spans costs one pass over the bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEGMENT = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 5)
_ROLL = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    if lower:
        codes[65:91] += U64(32)
    return mix(codes * U64(0xBF58476D1CE4E5B9) + U64(seed))


#: Random values per byte; the second family serves where 64 bits are too few.
PLAIN, PLAIN_2 = _byte_values(0x1234567, False), _byte_values(0x7654321, False)
LOWER, LOWER_2 = _byte_values(0x1234567, True), _byte_values(0x7654321, True)


def _flags(is_separator) -> np.ndarray:
    return np.array([is_separator(b) for b in range(256)], dtype=bool)


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACES = _flags(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
NON_WORD = _flags(lambda b: b < 0x80 and not chr(b).isalnum())
#: Separators of lines.
NEWLINE = _flags(lambda b: b == 0x0A)


class Spans(NamedTuple):
    """Byte spans of a batch: ``starts``/``ends`` of each, ``offsets`` by document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        """The document's number in the batch, for each span."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.per_doc)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null counts as empty) and the bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def split(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Spans:
    """Maximal runs of non-separators, never across two documents."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return Spans(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, U64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(max(n, _SEGMENT + 1), base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers


def span_hashes(spans: Spans, values: np.ndarray = PLAIN) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and disjoint."""
    data, starts, ends, _ = spans
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        piece = values[data[base : ends[j - 1]]]
        up, down = _power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, U64)
        np.cumsum(piece * up[: len(piece)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * _ROLL)


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` spans that lie within one document, and where they start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= _ROLL
        total += hashes[k : k + n]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(width, n + width) <= ends)
    return mix(total[at] + U64(width)), at


def in_blocks(table: pa.Table, column: str, most_bytes: int = 4 << 20):
    """Row ranges of ``table`` holding about ``most_bytes`` of text each (a longer text stands alone)."""
    if not table.num_rows:
        return
    sizes = pc.binary_length(table[column]).fill_null(0).to_numpy()
    block = np.cumsum(sizes, dtype=np.int64) // most_bytes
    cuts = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
        yield table.slice(lo, hi - lo)
