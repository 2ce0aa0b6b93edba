"""NumPy kernels shared by the text operators.

Everything here works on UTF-8 bytes as Arrow hands them over: no Python string
is built per word.  A slice of documents is joined with one separator byte.

A word's hash adds up one random value for each of its bytes and their places
(tabulation), so words have no structure that makes them collide; beyond
`PLACES` bytes it is XXH3.  There are two such hashes, with tables and seeds of
their own.  Runs of tokens are hashed with prefix polynomials modulo 2**64 over
token values, so the hash of any run is a difference of two prefix sums times an
inverse power; where 128 bits are asked for, each polynomial runs over a word hash
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Documents are handed to the kernels in slices of about this many bytes.
SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Two independent byte tables and odd multipliers (5 mod 8: full period).
TABLES = _RNG.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
#: Random values of a byte at each of the first PLACES places of a word, for two hashes.
PLACES = 32
_TABULATION = _RNG.integers(0, 1 << 64, size=(2, PLACES * 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15 & ~7 | 5, 0xC2B2AE3D27D4EB4F & ~7 | 5)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo 2**64."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = pow(BASES[which], -1, 1 << 64) if inverse else BASES[which]
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            with np.errstate(over="ignore"):
                np.multiply(have[:done], _U(pow(base, done, 1 << 64)), out=have[done : 2 * done])
            done *= 2
        _POWERS[which, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] = sum of values[i:j] times base**position."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(which, max(len(values), 1))[: len(values)], out=out[1:])
    return out


def run_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Mixed hashes of the runs [start, end)."""
    with np.errstate(over="ignore"):
        return mix((pre[end] - pre[start]) * powers(which, len(pre), True)[start])


def window_hash(pre: np.ndarray, k: int, which: int) -> np.ndarray:
    """Mixed hashes of all runs of k."""
    n = len(pre) - k
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((pre[k:] - pre[:n]) * powers(which, n, True))


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    if len(key) < w:
        return key[:0]
    width = 1
    while 2 * width <= w:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = w - width
    return np.minimum(key[:-rest], key[rest:]) if rest else key


# -- Arrow


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return off, raw


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes each; a longer row goes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def joined(off: np.ndarray, raw: np.ndarray, i: int, j: int, sep: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Rows i to j with one separator after each, and where each row starts."""
    lo, hi = int(off[i]), int(off[j])
    lengths = off[i + 1 : j + 1] - off[i:j]
    at = off[i:j] - lo + np.arange(j - i)
    out = np.full(hi - lo + (j - i), sep, np.uint8)
    if j - i == 1:
        out[: hi - lo] = raw[lo:hi]
    elif hi > lo:
        keep = np.ones(len(out), bool)
        keep[at + lengths] = False
        out[keep] = raw[lo:hi]
    return out, at


# -- words


def byte_class(pattern: str) -> np.ndarray:
    """1 for the bytes of word characters; bytes of 128 and more always are."""
    table = np.ones(256, np.uint8)
    for b in range(128):
        table[b] = pattern == "alnum" and (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90) or pattern == "space" and b not in (32, 9, 10, 11, 12, 13)
    return table


ALNUM, NOT_SPACE = byte_class("alnum"), byte_class("space")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes (buf ends with a separator)."""
    inside = table[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(buf) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, two: bool = False) -> np.ndarray:
    """64-bit hashes of the words [start, end), each followed by a separator; both, as (2, n), if two."""
    size = end - start
    out = np.empty((1 + two, len(start)), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, side="right")))
        lo, hi = start[i], end[j - 1] + 1
        first = (start[i:j] - lo).astype(np.int32)
        place = np.arange(hi - lo, dtype=np.int32) - np.repeat(first, np.diff(first, append=hi - lo))
        np.minimum(place, PLACES - 1, out=place)
        at = (place << 8 | buf[lo:hi]).astype(np.intp)
        edge = np.stack((first, end[i:j] - lo), axis=1).ravel()
        for k in range(1 + two):
            out[k, i:j] = mix(np.add.reduceat(_TABULATION[k].take(at), edge)[::2])
        i = j
    for w in np.flatnonzero(size > PLACES).tolist():
        word = buf[start[w] : end[w]].tobytes()
        for k in range(1 + two):
            out[k, w] = xxhash.xxh3_64_intdigest(word, seed=k + 1)
    return out if two else out[0]


def words(buf: np.ndarray, at: np.ndarray, table: np.ndarray, lower: bool = False, two: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, 64-bit hashes (both, as (2, n), if two) and row numbers of the words of joined rows."""
    if lower:
        buf = LOWER[buf]
    start, end = word_spans(buf, table)
    hashes = word_hashes(buf, start, end, two)
    row = np.searchsorted(at, start, side="right") - 1
    return start, end, hashes, row


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return shift + np.arange(total)


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Booleans of length n, true inside any [start, end)."""
    d = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(d)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]
