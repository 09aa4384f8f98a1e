"""Words of many texts at once, as NumPy arrays.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed
and carriage return. Hashes are 64 bits of a polynomial over random byte values,
so that any run of words is hashed by two lookups in a running sum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time; its arrays take some 50 times as much.
CHUNK_BYTES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spare(columns: Iterable[str], name: str) -> str:
    """``name``, or one made of it that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(number: int) -> np.uint64:
    """A well spread constant for each number."""
    return np.uint64(number * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_OTHER = mix(np.arange(257, 513, dtype=np.uint64) * _STEP)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; between() reads any stretch from them."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its texts begin; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    places = places.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[places[0] : places[-1]], places - places[0]


def chunks(places: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes, or of one text."""
    first = 0
    while first < len(places) - 1:
        last = int(np.searchsorted(places, places[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


class Words:
    """Words of a stretch of texts: byte spans, hashes, and bounds of each text's words.

    ``blank`` says which bytes part words.
    """

    def __init__(self, data: np.ndarray, places: np.ndarray, blank: np.ndarray = BLANK):
        solid = ~blank[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[places] = True
        near = np.zeros(len(data) + 2, bool)
        near[1:-1] = solid
        self.data = data
        self.start = np.flatnonzero(solid & (~near[:-2] | edge[:-1]))
        self.end = np.flatnonzero(solid & (~near[2:] | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, places)
        self.count = np.diff(self.bounds)
        self.sums = running(_BYTE[data])
        self.hash = between(self.sums, self.start, self.end)

    def second(self) -> np.ndarray:
        """Another 64 bits of hash, from other byte values."""
        return between(running(_OTHER[self.data]), self.start, self.end)

    def text_of(self) -> np.ndarray:
        """Number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def rest(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.bounds[1:], self.count) - np.arange(len(self.start))


def joined(data: np.ndarray, words: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """Each text's words, or those marked in ``keep``, joined by one space."""
    start, end, bounds = words.start, words.end, words.bounds
    if keep is not None:
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        start, end = start[keep], end[keep]
    size = end - start + 1
    ends = np.cumsum(size)
    source = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    body = data[np.minimum(source, max(len(data) - 1, 0))]
    body[ends - 1] = 32
    body = body.tobytes()
    places = np.concatenate([[0], ends])[bounds].tolist()
    return [body[a : max(a, b - 1)] for a, b in zip(places, places[1:], strict=False)]
