"""Whole-batch text arithmetic: words, word hashes and shingles of Arrow string columns.

A batch is cut into pieces of a few MB, each handled with numpy over its
UTF-8 bytes, so memory follows the piece (or the longest text), not the batch.
"""

from __future__ import annotations

import ctypes
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle


def to_workers(module) -> None:
    """Ship the functions of ``module`` with each task, so executors need no package path."""
    cloudpickle.register_pickle_by_value(module)


#: numpy holds about ten 8-byte values per byte of a piece: 256 KB of text take some 20 MB.
PIECE_BYTES = 1 << 18
#: Separators of words: space and 0x09 to 0x0D.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SEED = 20240229


def release() -> None:
    """Give the memory of earlier batches back to the system: workers are reused from stage to stage and don't shrink by themselves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def filled(column: pa.Array) -> pa.Array:
    """A string column without nulls (null texts are empty); called once a batch, it gives back what earlier ones took."""
    release()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column.fill_null("") if column.null_count else column).cast(pa.string())


def pieces(column: pa.Array, limit: int = PIECE_BYTES):
    """Yield (first row, end row) of pieces of at most ``limit`` bytes, one text at least."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else [0]
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the n + 1 offsets of the texts in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of the words of a batch, by a polynomial over random byte values.

    ``fold_ascii`` takes A-Z as a-z; ``separators`` are the bytes between words.
    """

    def __init__(self, fold_ascii: bool = True, separators: bytes = SEPARATORS, seed: int = SEED):
        values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        if fold_ascii:
            values[65:91] = values[97:123]
        self.values = values
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.base = np.uint64(0xD1342543DE82EF95)
        self.unbase = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.unpowers = np.ones(1, np.uint64)

    def _steps(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse; kept up to the size of a piece."""
        if len(self.powers) >= n:
            return self.powers, self.unpowers
        both = []
        for base in (self.base, self.unbase):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if n <= 2 * PIECE_BYTES:
            self.powers, self.unpowers = both
        return both[0], both[1]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words start and end."""
        word = ~self.separator[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        return starts, ends

    def _blocks(self, data: np.ndarray) -> list[int]:
        """Places to cut ``data`` into blocks of about a piece, each where a word ends."""
        cuts = [0]
        while len(data) - cuts[-1] > 2 * PIECE_BYTES:
            at = cuts[-1] + PIECE_BYTES
            while at < len(data) and not (gap := self.separator[data[at:at + PIECE_BYTES]]).any():
                at += PIECE_BYTES
            if at >= len(data):
                break
            cuts.append(at + int(gap.argmax()))
        return [*cuts, len(data)]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, n + 1 word offsets of the texts).  A long text is worked through in blocks."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        starts, ends = self.spans(data, offsets)
        hashes = np.empty(len(starts), np.uint64)
        cuts = self._blocks(data)
        at = np.searchsorted(starts, cuts)
        for a, b, first, end in zip(cuts[:-1], cuts[1:], at[:-1], at[1:]):
            powers, unpowers = self._steps(b - a)
            sums = np.empty(b - a + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.values[data[a:b]] * powers[:b - a], out=sums[1:])
            hashes[first:end] = mix((sums[ends[first:end] - a] - sums[starts[first:end] - a]) * unpowers[starts[first:end] - a])
        return hashes, np.searchsorted(starts, offsets)


def factors(k: int) -> np.ndarray:
    return np.random.default_rng(SEED + k).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (of a whole batch; those across texts are to be left out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, f in enumerate(factors(k)):
        out += words[j:j + n] * f
    return mix(out)


def text_shingles(runs: np.ndarray, words: np.ndarray, first: int, end: int, k: int) -> np.ndarray:
    """Shingle hashes of the text whose words are [first, end); fewer than ``k`` words make one shingle."""
    n = end - first
    if n >= k:
        return runs[first:end - k + 1]
    if n == 0:
        return np.zeros(0, np.uint64)
    f = factors(k)[:n]
    return mix(np.array([(words[first:end] * f).sum(dtype=np.uint64) + np.uint64(n)], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))


def counts_to_rows(counts: np.ndarray, slices: int) -> pa.RecordBatch:
    """Rows (slice, zlib-packed int64 counts) of a count vector, to be added up by ``sum_counts``."""
    parts = counts.reshape(slices, -1)
    return pa.record_batch({"slice": pa.array(range(slices), pa.int32()), "counts": pa.array([zlib.compress(p.astype(np.int64).tobytes(), 1) for p in parts], pa.binary())})


def add_rows(batches):
    """Add up the packed counts of each slice, as they stream in."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, packed in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
            got = np.frombuffer(zlib.decompress(packed), np.int64)
            sums[s] = sums[s] + got if s in sums else got
    for s, v in sums.items():
        yield pa.record_batch({"slice": pa.array([s], pa.int32()), "counts": pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())})


COUNT_SCHEMA = "slice int, counts binary"


def sum_counts(rows, slices: int, width: int) -> np.ndarray:
    """The sum, as one vector of a fixed size, of the count vectors that tasks emitted."""
    out = np.zeros((slices, width // slices), np.int64)
    for r in rows.repartition(min(slices, 64), "slice").mapInArrow(add_rows, COUNT_SCHEMA).collect():
        out[r["slice"]] += np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(-1)


to_workers(sys.modules[__name__])
