"""Text columns of Arrow batches as flat byte arrays, and words in them as hashed spans.

Helpers for functions that Spark runs on batches; they hold one slice of a batch at a time.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20  # texts handled at once; a longer text is a slice of its own
SMALL_SLICE = 1 << 18  # for functions with many numbers a byte
BATCH_ROWS = 1000
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, True for the bytes in the inclusive ranges."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low:high + 1] = True
    return flags


# Word bytes of lower-cased text: digits, a-z and everything beyond ASCII.
LETTERS = table_of((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
# Everything but space and the five ASCII controls that count as white space.
NO_BLANKS = ~table_of((0x20, 0x20), (0x09, 0x0D))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and their offsets (rows + 1); NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n, skip = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, skip * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def bound_batches(spark, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches of this session have at most ``rows`` rows; a smaller setting stays.

    A batch holds whole texts twice, in the JVM and in Python, beside what earlier stages left there.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def hand_back(spark) -> None:
    """Let the Python workers return to the system what earlier jobs freed.

    Workers are reused from job to job, and the allocators below numpy and Arrow keep freed memory for the
    next task. In a flow of several stages that adds up beside the JVM. A round of tiny tasks trims every worker that idles.
    """
    def run(batches):
        for _ in batches:
            pass
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
        yield from ()

    tasks = 4 * max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of consecutive rows of about ``limit`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Maximal runs of ``inside`` bytes that don't cross rows: starts, ends, first run of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    flags = inside[data]
    begins, stops = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1]
    stops[:-1] &= ~flags[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = flags[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[tails] = flags[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class SpanHash:
    """64-bit hashes of byte spans from prefix sums; equal bytes hash alike wherever they stand."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, U64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.power) <= n:
            size = max(SLICE_BYTES, n)
            self.power, self.inverse = (
                np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size, b, U64)]))
                for b in (BASE, INVERSE))
        sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * self.power[:n], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverse[starts]
                   + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def words(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        """Hashes of the runs of ``inside`` bytes, their starts and ends, first run of each row."""
        starts, ends, first = spans(data, offsets, inside)
        return self.of(self.prefix(data), starts, ends), starts, ends, first


def hash_words(words: list[str]) -> np.ndarray:
    """The hash that ``SpanHash`` gives to each of these words."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    hasher = SpanHash()
    return hasher.of(hasher.prefix(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


class KeyTable:
    """Places of 64-bit keys, looked up many at a time; -1 for a key that isn't there."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.asarray(keys, U64)
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys if len(keys) else np.zeros(1, U64)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot the last stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(BASE)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[at[open_]]
            again = found[open_]
            open_ = open_[(again >= 0) & (self.keys[again] != keys[open_])]
        return found


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]`` for every i, 0 for an empty run."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(first[:-1] < first[1:])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0, dtype=np.float64)
    return out
