"""Words of whole texts as byte ranges and 64-bit hashes, for all texts of an Arrow batch at once.

Text is folded byte by byte (A-Z to a-z) and cut at ASCII delimiters, so UTF-8 sequences stay whole. A word's hash is a
polynomial over random byte values modulo 2**64, read off running sums: no Python object is made for a word. Work
proceeds in pieces of whole texts of about `PIECE` bytes, so memory follows the piece (or the one longest text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
_BYTES = np.arange(256)
FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Delimiters (after folding) of the words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACES = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
MARKS = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
_BASE = np.uint64(0x9E6C63D0876A9A47)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n; kept up to the size of a piece."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n + 1, PIECE + 1)
    tables = []
    for step in (_BASE, _INVERSE):
        t = np.full(size, step, np.uint64)
        t[0] = 1
        tables.append(np.cumprod(t, dtype=np.uint64))
    if size <= 2 * PIECE:
        _powers[:] = tables
    return tables[0], tables[1]


@dataclass
class Words:
    """Words of the texts first, first + 1, ... of a batch; word i is data[starts[i]:ends[i]], text j has words bounds[j] to bounds[j + 1] - 1."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def text_of(self) -> np.ndarray:
        """Number (within this piece) of each word's text."""
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))

    def get(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all k consecutive words within one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        acc = self.hashes[:n].copy()
        for j in range(1, k):
            acc = mix(acc) * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j : j + n]
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.flatnonzero(np.arange(n) + k <= last[:n])
        return at, mix(acc[at] + np.uint64(k))


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def scan(column: pa.Array | pa.ChunkedArray, delimiters: np.ndarray, hashed: bool = True) -> Iterator[Words]:
    """Words of every text of an Arrow string column, piece by piece."""
    data, offsets = binary_parts(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        yield _words(data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first], delimiters, first, hashed)
        first = stop


def _words(raw: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray, first: int, hashed: bool) -> Words:
    data = FOLD[raw]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~delimiters[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    hashes = np.empty(0, np.uint64)
    if hashed:
        up, down = _power_tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(first, data, starts, ends, bounds, hashes)


def spans_to_mask(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:n] > 0


def id_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names and types; whatever else the table has is pruned."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
