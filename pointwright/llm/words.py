"""Words of whole texts, vectorised.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, which is
the pattern [^\\x20\\x09-\\x0D]+ on code points. Arrow string columns are read as one byte
buffer, so no Python string is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one step of the vectorised functions holds (a longer text is one step).
STEP_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE, _BASE_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, dtype=U)
        have[1:] = U(base)
        np.multiply.accumulate(have, out=have)
        if size <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def steps(batch: pa.RecordBatch | pa.Table, text: str, most: int = STEP_BYTES) -> Iterator[pa.Table]:
    """Slices of whole rows with at most so many bytes of text, or one row."""
    if isinstance(batch, pa.RecordBatch):
        batch = pa.Table.from_batches([batch])
    if batch.num_rows == 0:
        return
    sizes = batch.column(text).combine_chunks()
    sizes = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


class Words:
    """Word bounds of a batch of texts: start, end (bytes), doc (row); first[d]..first[d+1] are row d's words."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        self.data, self.offsets = text_buffers(column)
        if lower:
            self.data = LOWER_AZ[self.data]
        n, off = len(self.data), self.offsets
        word = ~IS_SPACE[self.data]
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        at = off[:-1][off[:-1] < n]
        starts[at] |= word[at]  # a text begins a word of its own
        self.start = np.flatnonzero(starts)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        at = off[1:][(off[1:] > 0)] - 1
        ends[at] |= word[at]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial over mixed byte values, mixed again."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, dtype=U)
        sums = np.zeros(n + 1, dtype=U)
        np.multiply(BYTE_VALUES[self.data], powers(_BASE, n), out=sums[1:])
        np.add.accumulate(sums, out=sums)
        h = sums[self.end] - sums[self.start]
        h *= powers(_BASE_INV, n)[self.start]
        return mix64(h + (self.end - self.start).astype(U))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, one for each start (across documents too: mask them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    h = np.zeros(n, dtype=U)
    for j in range(k):
        h *= U(_BASE)
        h += words[j : j + n]
    return mix64(h)


def inside(w: Words, k: int) -> np.ndarray:
    """For each start of k words in a row: are they of one document?"""
    return w.doc[: max(0, len(w) - k + 1)] == w.doc[k - 1 :]
