"""Many texts as one byte array: words, hashes and chunks for numpy."""

from __future__ import annotations

import ctypes
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random odd number for each byte value, and the base of the polynomial hash with its inverse mod 2**64.
BYTE_CODE = _RNG.integers(0, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, np.ndarray] = {}


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_TIDIED = 0.0


def tidy(every: float = 0.5) -> None:
    """Hand back to the system what this worker has freed, at most once in ``every`` seconds.

    A worker serves many stages; the C library and Arrow would otherwise keep
    the most that any of them has needed.
    """
    global _TIDIED
    now = time.monotonic()
    if now - _TIDIED >= every:
        _TIDIED = now
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


_HELD: list = [None, None]


def held(key, build):
    """What ``build()`` gives, built once by each worker for all its tasks that follow each other; the one before is let go."""
    if _HELD[0] != key:
        let_go()
        _HELD[:] = [key, build()]
    return _HELD[1]


def let_go() -> None:
    """Forget what ``held`` keeps: an encoder or automaton of an earlier stage is no use to the next."""
    _HELD[:] = [None, None]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and n + 1 offsets."""
    tidy()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` bytes each (a longer text stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes for which ``in_word[byte]``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = in_word[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edge = offsets[1:-1]
    first[edge[edge < len(data)]] = True
    starts = np.nonzero(inside & first)[0]
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = first[1:] | ~inside[1:]
    ends = np.nonzero(inside & last)[0] + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Spans up to so many bytes are hashed and compared block by block, longer ones one by one.
LONG = 256
_BLOCK_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _blocks_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: its eight-byte blocks through a chain of finalisers, begun with seed and length; blake2b for long ones.

    No family of spans is known to collide, as there is for polynomials modulo
    2**64; two given spans do by a chance of about 2**-64.
    """
    size = ends - starts
    h = mix(size.astype(U64) * U64(BASE) + mix(np.full(len(size), seed + 1, U64)))
    block = _blocks_at(data)
    todo, at = np.nonzero((size > 0) & (size <= LONG))[0], 0
    while len(todo):
        left = size[todo] - at
        h[todo] = mix((h[todo] ^ (block[starts[todo] + at] & _BLOCK_MASK[np.minimum(left, 8)])) * U64(BASE) + U64(0x632BE59BD9B4E019))
        todo, at = todo[left > 8], at + 8
    for i in np.nonzero(size > LONG)[0]:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Which spans equal their counterparts in ``other`` byte by byte."""
    size = ends - starts
    same = size == other_ends - other_starts
    one, two = _blocks_at(data), _blocks_at(other)
    todo, at = np.nonzero(same & (size > 0) & (size <= LONG))[0], 0
    while len(todo):
        left = size[todo] - at
        equal = (one[starts[todo] + at] ^ two[other_starts[todo] + at]) & _BLOCK_MASK[np.minimum(left, 8)] == 0
        same[todo[~equal]] = False
        todo, at = todo[equal & (left > 8)], at + 8
    for i in np.nonzero(same & (size > LONG))[0]:
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
    return same


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gets the hash of any span."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts] + (ends - starts).astype(U64))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of many ranges one after another: starts[0], starts[0] + 1, ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
