"""Word hashing over whole Arrow columns, without a Python object per word.

Texts are read as the UTF-8 bytes of an Arrow string column.  A byte-class
table marks separators (all separators used here are ASCII, so bytes and code
points agree), word boundaries come from one vectorised scan, and every word
gets a 64-bit polynomial hash from a running sum.  Work goes in blocks of
about half a megabyte; a longer text is a block of its own, so memory is some
forty bytes per byte of the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def _random_u64(tag: str, count: int) -> np.ndarray:
    """A fixed table of 64-bit numbers derived from a tag."""
    raw = hashlib.shake_128(tag.encode()).digest(8 * count)
    return np.frombuffer(raw, dtype="<u8").copy()


_BYTE_CODE = _random_u64("byte-code", 256) | np.uint64(1)
_FOLDED_CODE = _BYTE_CODE.copy()
_FOLDED_CODE[65:91] = _BYTE_CODE[97:123]
GRAM_FACTORS = _random_u64("gram-factors", 64) | np.uint64(1)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters (capitals count as letters: they are lower-cased first).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)
        if size > 8 * BLOCK_BYTES:  # one very long text should not pin its tables
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambles 64-bit hashes (a bijection for each salt)."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Some consecutive rows: bytes, the rows' byte bounds, words and the rows' word bounds."""

    first: int  # number of the first row in its batch
    data: np.ndarray  # uint8
    bounds: np.ndarray  # row i has bytes bounds[i]:bounds[i + 1]
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray  # uint64, one for each word
    words: np.ndarray  # row i has words words[i]:words[i + 1]

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all n-word windows inside a row, the word each begins at, and the rows' bounds in them."""
        count = np.diff(self.words)
        if len(self.hash) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(self.rows + 1, np.int64)
        total = np.zeros(len(self.hash) - n + 1, np.uint64)
        for k in range(n):
            total += self.hash[k : k + len(total)] * GRAM_FACTORS[k]
        fits = np.maximum(count - (n - 1), 0)
        bounds = np.concatenate([[0], np.cumsum(fits)])
        at = np.arange(bounds[-1]) + np.repeat(self.words[:-1] - bounds[:-1], fits)
        return mix(total[at], n), at, bounds


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, bounds


def scan(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, fold: bool, first: int = 0) -> Block:
    """Finds and hashes the words of consecutive rows; fold lower-cases A-Z."""
    inside = ~separators[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    if len(data):
        edge = bounds[:-1][bounds[:-1] < len(data)]
        begin[edge] = inside[edge]
        edge = bounds[1:][bounds[1:] > 0] - 1
        stop[edge] = inside[edge]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = _power_tables(len(data) + 1)
    code = (_FOLDED_CODE if fold else _BYTE_CODE)[data]
    code *= up[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code, out=total[1:])
    hashed = (total[end] - total[start]) * down[start]
    return Block(first, data, bounds, start, end, mix(hashed), np.searchsorted(start, bounds))


def blocks(column, separators: np.ndarray, fold: bool, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Splits a column into blocks of whole rows and scans each."""
    raw, bounds = text_bytes(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        yield scan(raw[bounds[row] : bounds[last]], bounds[row : last + 1] - bounds[row], separators, fold, row)
        row = last


def gram_sets(block: Block, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its number and its distinct n-word shingles, sorted; with fewer words the whole sequence is one."""
    hashes, _, bounds = block.grams(n)
    for i in range(block.rows):
        own = hashes[bounds[i] : bounds[i + 1]]
        if not len(own) and block.words[i + 1] > block.words[i]:
            few = block.hash[block.words[i] : block.words[i + 1]]
            own = mix((few * GRAM_FACTORS[: len(few)]).sum(dtype=np.uint64, keepdims=True), 100 + len(few))
        yield block.first + i, np.unique(own)
