"""Vectorised byte kernels shared by the operators that run in Arrow batches.

Texts stay in the Arrow buffers they arrive in: a batch is one byte array plus
row offsets, and words, windows and hashes are computed for the whole batch
with numpy.

There are two kinds of hashes.  ``prefix_hash``, ``range_hash`` and
``rolling_hash`` are polynomials modulo 2**64: cheap, equal for equal ranges,
but long texts can be made that collide under any multiplier.  They only
select candidates.  What decides (``sound_*``, ``digests``) are polynomials
modulo the prime 2**31 - 1, each lane with a base of its own, so that two
texts of n values agree in a lane with probability n / 2**31 at most, or
XXH3 digests of the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15 | 1)
MULT_INV = U64(pow(int(MULT), -1, 1 << 64))
SLICE_BYTES = 1 << 19


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives its memory back when its task ends: Python workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _POWERS.clear()
        _PRIME_POWERS.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            return

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLES: dict[int, np.ndarray] = {}
_POWERS: dict[int, np.ndarray] = {}


def byte_table(seed: int) -> np.ndarray:
    if seed not in _TABLES:
        _TABLES[seed] = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed * 2654435761 + 1))
    return _TABLES[seed]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = int(inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, MULT_INV if inverse else MULT, dtype=U64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size > 16 * SLICE_BYTES:
            return out
        _POWERS[key] = have = out
    return have


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P[i] = sum of values[j] * MULT**j over j < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values))[: len(values)], dtype=U64, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], independent of where the range lies."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start])


PRIME = U64((1 << 31) - 1)
_PRIME_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**63."""
    x = (x & PRIME) + (x >> U64(31))
    x = (x & PRIME) + (x >> U64(31))
    x[x >= PRIME] -= PRIME
    return x


def _prime_powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the lane's base and of its inverse."""
    have = _PRIME_POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = int(mix(np.array([seed + 1], dtype=U64) * U64(0xD1342543DE82EF95))[0]) % (int(PRIME) - 3) + 2
        out = []
        for b in (base, pow(base, -1, int(PRIME))):
            p = np.ones(size, dtype=U64)
            k, step = 1, b
            while k < size:
                z = min(2 * k, size)
                p[k:z] = _reduced(p[: z - k] * U64(step))
                k, step = 2 * k, step * step % int(PRIME)
            out.append(p)
        have = (out[0], out[1])
        if size <= 16 * SLICE_BYTES:
            _PRIME_POWERS[seed] = have
    return have


def sound_prefix(data: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums over bytes in the lane ``seed``."""
    key = -1 - seed
    if key not in _TABLES:
        _TABLES[key] = byte_table(seed) % (PRIME - U64(1)) + U64(1)
    x = _TABLES[key][data] * _prime_powers(seed, len(data))[0][: len(data)]
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((x & PRIME) + (x >> U64(31)), dtype=U64, out=out[1:])
    return out


def sound_range(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """31 bits: the lane's hash of data[start:end], independent of where the range lies."""
    return _reduced(_reduced(prefix[end] - prefix[start]) * _prime_powers(seed, len(prefix))[1][start])


def sound_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: tuple[int, int]) -> np.ndarray:
    """62 bits of two lanes for each range, mixed to 64."""
    a, b = (sound_range(sound_prefix(data, x), start, end, x) for x in seeds)
    return mix(a << U64(31) | b)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 with 128 bits of each range, as two columns of signed integers."""
    hashed = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([hashed(raw[a:z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a slice with one space after each that something follows, and the words' bounds in it: runs of words are equal as the bytes they span."""
    keep = covered(len(data), starts, ends - starts) if len(starts) else np.zeros(len(data), dtype=bool)
    space = np.zeros(len(data), dtype=bool)
    space[ends[ends < len(data)]] = True
    space &= ~keep
    at = np.cumsum(keep | space)
    out = np.where(space, np.uint8(0x20), data)[keep | space]
    return out.tobytes(), at[starts] - 1, at[ends - 1]


def rolling_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    p = prefix_hash(values)
    return mix((p[size:] - p[:n]) * powers(len(p), inverse=True)[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in log2(width) passes."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:])[:n] if rest else x[:n]


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Lookup table over bytes: True for the bytes in the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Space and the control characters 9 to 13.
SPACE = separators([(0x20, 0x20), (0x09, 0x0D)])
#: All ASCII but digits and lower-case letters.
PUNCTUATION = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about ``limit`` text bytes (a longer text is a slice of its own).

    Yields the rows, their UTF-8 bytes end to end, and the row offsets in
    them; a null text counts as empty.
    """
    index = batch.schema.get_field_index(column)
    texts = batch.column(index)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word index at which each row begins (one more entry than rows)."""
    inside = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(rows: np.ndarray, count: int) -> np.ndarray:
    """The row of each of ``count`` items, from the item index at which each row begins."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:count]


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) over all ranges."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Mask over 0..n-1 of the positions inside any of the ranges."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + lengths, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """Maximum of every ``width`` consecutive values."""
    return ~sliding_min(~x, width)


def window_runs(shingles: np.ndarray, row: np.ndarray, valid: np.ndarray, width: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the windows of all rows into runs by the minimum of their shingle hashes.

    ``shingles`` has the hash of the shingle at every position, a window is
    ``width`` consecutive shingles, ``row`` and ``valid`` tell for the window at
    each position its row and whether it lies inside one.  Windows that are
    equal have equal minima, so only windows of runs with equal minima can be
    equal.  Returns for each run of at most ``longest`` windows its minimum,
    first position, length, and how often the minimum occurs in its shingles.
    """
    low = sliding_min(shingles, width)
    n = len(low)
    if not n or not valid[:n].any():
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U64), z, z, z
    row, valid = row[:n], valid[:n]
    new = np.ones(n, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    edge = np.flatnonzero(new | ~valid)
    size = np.diff(np.append(edge, n))
    keep = valid[edge]
    edge, size = edge[keep], size[keep]
    if len(size) and size.max() > longest:
        pieces = (size + longest - 1) // longest
        of = np.repeat(np.arange(len(size)), pieces)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        edge, size = edge[of] + k * longest, np.minimum(longest, size[of] - k * longest)
    key = low[edge]
    # positions whose shingle is the minimum of a window there
    best = np.where(valid, low, U64(0))
    best = sliding_max(np.concatenate([np.zeros(width - 1, dtype=U64), best, np.zeros(width - 1, dtype=U64)]), width)[: len(shingles)]
    at = np.flatnonzero((best == shingles) & (best > 0))
    value, which = np.unique(shingles[at], return_inverse=True)
    spot = np.sort(which.astype(np.int64) << 40 | at)
    of = np.searchsorted(value, key).astype(np.int64) << 40
    times = np.searchsorted(spot, of | (edge + size + width - 1)) - np.searchsorted(spot, of | edge)
    return key, edge, size, times
