"""Words of texts as numpy arrays of hashes, for the tasks that compare word sequences.

A word is a run of characters other than space and U+0009 to U+000D, in Spark expressions and here alike.
Texts are cut on their UTF-8 bytes, where those six separators are single bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[ \t-\r]+"
# Odd multipliers of the polynomial hashes, and of the finaliser of MurmurHash3.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
FINAL_1, FINAL_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def word_array(text: Column) -> Column:
    """The words of a text column as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(FINAL_1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(FINAL_2)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        known = np.cumprod(grown)
        if n <= SLICE_BYTES + 1:  # a longer text is rare; its powers aren't held for the next ones
            _POWERS[base] = known
    return known[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for every pair: polynomial modulo 2 ** 64, shifted to power zero and mixed."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    shifted = (total[end] - total[start]) * powers(_inverse(base), len(values) + 1)[start]
    return mix(shifted + (end - start).astype(np.uint64) * np.uint64(FINAL_2))


class Texts:
    """Words of a run of documents: byte bounds in ``data``, a hash each, and ``first[i]:first[i + 1]`` per document."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        self.bounds = bounds - bounds[0]
        solid = ~_SPACE[self.data]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(self.data))]
        cut = np.zeros(len(self.data) + 1, dtype=bool)  # a word may not go over this position
        cut[inner] = True
        cut[0] = cut[-1] = True
        before, after = np.ones(len(solid), dtype=bool), np.ones(len(solid), dtype=bool)
        before[1:] = ~solid[:-1] | cut[1:-1]
        after[:-1] = ~solid[1:] | cut[1:-1]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.hashes = range_hashes(self.data, self.start, self.end, BYTE_BASE)
        self.first = np.searchsorted(self.start, self.bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (word number) and hash of every window of ``length`` words that lies in one document."""
        counts = self.counts
        room = np.maximum(counts - length + 1, 0)
        start = np.arange(len(self.hashes))
        start = start[start - np.repeat(self.first[:-1], counts) < np.repeat(room, counts)]
        return start, range_hashes(self.hashes, start, start + length, WORD_BASE)

    def words(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The words of a document, or those kept, joined by one space."""
        at = np.arange(self.first[doc], self.first[doc + 1])
        at = at if keep is None else at[keep]
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[at].tolist(), self.end[at].tolist()))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` neighbours, in log2(width) passes."""
    have, out = 1, values
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = best(out[:len(values) - width + 1], out[width - have:])
    return out


def selected(texts: Texts, length: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Content-selected windows (winnowing): starts and hashes of ``length``-word windows.

    A window is selected when its hash is the least of some run of windows that covers exactly ``span`` words of
    one document. So equal passages of ``span`` words, wherever they stand, hold equal selected windows at equal
    places, one at least.
    """
    width = span - length + 1
    start, value = texts.windows(length)
    n = len(texts.hashes)
    if width < 1 or n < span or not len(start):
        return start[:0], value[:0]
    full = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[start] = value
    low = sliding(full, width, np.minimum)  # low[q]: of the windows q .. q + width - 1
    counts = texts.counts
    offset = np.arange(n) - np.repeat(texts.first[:-1], counts)
    whole = offset + span <= np.repeat(counts, counts)  # the run starting here lies in one document
    low = np.where(whole[:len(low)], low, np.uint64(0))
    padded = np.zeros(len(low) + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1:width - 1 + len(low)] = low
    reach = np.zeros(n, dtype=np.uint64)
    top = sliding(padded, width, np.maximum)
    reach[:len(top)] = top[:n]
    chosen = (reach[start] == value) & (reach[start] > 0)
    return start[chosen], value[chosen]
