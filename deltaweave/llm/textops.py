"""Numpy primitives over Arrow string columns, shared by the operators.

Texts stay as one byte array with offsets, so that hashing words, lines and
n-grams costs a few vector passes instead of a Python call a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Modulus and bases of the two polynomials that hash a span.
PRIME = (1 << 31) - 1
BASES = (1_220_703_133, 1_815_976_681)
#: Bytes whose products with powers add up to less than 2**64.
_SAFE = 1 << 22
_powers: dict[int, np.ndarray] = {}


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(rows: Iterator) -> Iterator:
    """rows; then memory that this worker no longer uses goes back to the system, as workers outlive their tasks."""
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seed_of(*parts: int) -> np.uint64:
    h = np.array([0x1234567], dtype=np.uint64)
    for p in parts:
        h = mix(h * U64(3) + U64(p & _MASK))
    return h[0]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    x = (x & U64(PRIME)) + (x >> U64(31))
    return np.where(x >= PRIME, x - U64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME, for i below n at least."""
    have = _powers.get(base, np.ones(1, dtype=np.uint32))
    while len(have) < n:
        have = np.append(have, _reduced(have * U64(pow(base, len(have), PRIME))).astype(np.uint32))
        _powers[base] = have
    return have


def strings(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def to_strings(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """A string column from bytes and offsets; mask marks nulls."""
    valid = None
    nulls = 0
    if mask is not None and mask.any():
        valid, nulls = pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes()), int(mask.sum())
    out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [valid, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))], null_count=nulls)
    return out.cast(pa.string()) if offsets[-1] < 2**31 - 1 else out


def pieces(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, each of about limit bytes or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cumulative sums, one for each of BASES, from which span_hash gives the hash of any span."""
    out, codes = [], data.astype(np.uint64) + U64(1)
    for base in BASES:
        cum = np.zeros(len(data) + 1, dtype=np.uint64)
        x = codes * powers(base, len(data) + 1)[: len(data)]
        for i in range(0, len(data), _SAFE):
            np.cumsum(x[i : i + _SAFE], out=cum[i + 1 : i + _SAFE + 1])
            cum[i + 1 : i + _SAFE + 1] += cum[i]
            if len(data) > _SAFE:
                cum[i + 1 : i + _SAFE + 1] = _reduced(cum[i + 1 : i + _SAFE + 1])
        out.append(cum)
    return tuple(out)


def span_hash(cum: tuple[np.ndarray, ...], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the span lies.

    Two polynomials modulo a prime: two different spans of n bytes share both
    values for (n / 2**31)**2 of all pairs of bases at most, whatever the texts'
    structure. What must not take one text for another compares more than this.
    """
    h = (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    for base, c in zip(BASES, cum, strict=True):
        down = powers(pow(base, -1, PRIME), len(c))
        x = _reduced(c[ends] + U64(PRIME << 32) - c[starts]) if len(c) <= _SAFE + 1 else _reduced(c[ends] + U64(PRIME) - c[starts])
        h = mix((h << U64(31) | h >> U64(33)) + _reduced(x * down[starts]))
    return h


def byte_table(f) -> np.ndarray:
    return np.array([f(b) for b in range(256)])


#: ASCII upper case to lower case; other bytes as they are.
LOWER = byte_table(lambda b: b + 32 if 65 <= b <= 90 else b).astype(np.uint8)
#: Letters, digits and all bytes of non-ASCII characters belong to words.
IN_WORD = byte_table(lambda b: b >= 128 or chr(b).isalnum())
#: Everything but ASCII white space.
NOT_SPACE = byte_table(lambda b: b not in b" \t\n\r\x0b\x0c")


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of inside, cut at the texts' borders; the runs before each text."""
    n = len(inside)
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = inside
    cut = offsets[:-1]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The flags set in each text."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(flags.view(np.uint8), offsets[:-1][full], dtype=np.int64)
    return out


def segment_sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x[bounds[i]:bounds[i+1]]."""
    out = np.zeros(len(bounds) - 1, dtype=x.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, bounds[:-1][full])
    return out


def sort_segments(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorts each x[bounds[i]:bounds[i+1]] in place; the mask of first occurrences."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x[a:b].sort()
    first = np.ones(len(x), dtype=bool)
    first[1:] = x[1:] != x[:-1]
    first[bounds[:-1][bounds[:-1] < len(x)]] = True
    return first
