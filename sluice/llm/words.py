"""Words and shingles of whole texts as 64-bit numbers, computed on the bytes of an Arrow column.

A word is a longest run of bytes other than space, tab, LF, VT, FF and CR; A-Z count as a-z.
Memory is bounded by the texts of one slice: about a MB, or one document if that is longer.
"""

from contextlib import contextmanager

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]
_powers = {}


def mix(x):
    """The splitmix64 finaliser: a one-to-one scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int):
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, _BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array):
    """The bytes of a text column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return data, ends - ends[0]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """(first row, bytes, offsets) of runs of documents with about `size` bytes each."""
    data, ends = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def split_words(data, offsets):
    """(hash, start, end) of each word and, for each document, where its words begin."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def _hashes(data, starts, ends):
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        base, size = starts[i], int(ends[j - 1] - starts[i])
        up, down = powers(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_CODE[data[base:base + size]] * up[:size], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def shingles(hashes, bounds, n: int, short: bool = True):
    """Hashes of n consecutive words, and where those of each document begin.

    A document with fewer words has, if `short`, its whole sequence as one shingle; one without
    words has none.
    """
    total = len(hashes)
    counts = np.diff(bounds)
    combined = np.zeros(max(0, total - n + 1), np.uint64)
    for k in range(n):
        combined += hashes[k:total - n + 1 + k] * np.uint64(pow(_BASE, 2 * k + 3, 1 << 64) | 1)
    combined = mix(combined)
    sizes = np.maximum(0, counts - n + 1)
    take = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) \
        if len(sizes) else np.zeros(0, np.int64)
    out = combined[take]
    if short and ((counts > 0) & (counts < n)).any():
        pieces, at = [], np.concatenate(([0], np.cumsum(sizes)))
        done = 0
        for d in np.flatnonzero((counts > 0) & (counts < n)):
            value = np.uint64(counts[d])
            for k, h in enumerate(hashes[bounds[d]:bounds[d + 1]]):
                value = np.uint64((int(value) + int(h) * (pow(_BASE, 2 * k + 3, 1 << 64) | 1)) % (1 << 64))
            pieces += [out[done:at[d]], mix(np.array([value], np.uint64))]
            done = at[d]
            sizes[d] = 1
        out = np.concatenate([*pieces, out[done:]])
    return out, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


@contextmanager
def small_batches(spark, rows: int = 500, size: int | None = None):
    """While jobs run in here, at most `rows` rows and about `size` bytes go to Python at once, as these rows hold whole sets of shingles."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name, most in limits.items() if most}
    for name, old in before.items():
        if name.endswith("BytesPerBatch") or not 0 < int(old) <= limits[name]:
            spark.conf.set(name, str(limits[name]))
    try:
        yield
    finally:
        for name, old in before.items():
            spark.conf.set(name, old)


def texts_of(texts) -> pa.Array:
    """A list of Python texts as a column; used by tests and small query sets."""
    return pa.array(texts, pa.string())
