"""Vectorised byte-level text routines shared by the operators.

Texts come as Arrow batches and are handled as one byte array with offsets, a
bounded piece at a time; nothing here loops over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
GOLD, MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: An odd base and its inverse modulo 2**64, for hashes of byte or word ranges by prefix sums.
BASE = U64(0xD1342543DE82EF95)
UNBASE = U64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``most_bytes``; a longer text is alone in its slice."""
    sizes = np.diff(flat(batch.column(column))[1])
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces whose texts hold about ``most_bytes``: small batches are joined, large ones cut."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(flat(batch.column(column))[0])
        if size >= most_bytes:
            yield from pieces(pa.concat_batches(held), column, most_bytes)
            held, size = [], 0
    if held:
        yield from pieces(pa.concat_batches(held), column, most_bytes)
    del held
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after another, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Lower-cased bytes, 0 where a byte separates words.
WORD_BYTES = np.arange(256, dtype=np.uint8)
WORD_BYTES[65:91] += 32
BLANK_WORDS = WORD_BYTES.copy()
BLANK_WORDS[[9, 10, 11, 12, 13, 32]] = 0  # words are [^\x20\x09-\x0D]+
ALNUM_WORDS = WORD_BYTES.copy()
ALNUM_WORDS[0:48] = 0  # words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text
ALNUM_WORDS[58:65] = 0
ALNUM_WORDS[91:97] = 0
ALNUM_WORDS[123:128] = 0
BLANK_IS_WORD = np.ones(256, bool)
BLANK_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
ALNUM_IS_WORD = ALNUM_WORDS > 0


#: Words are hashed by a polynomial over the integers modulo the prime 2**61 - 1. Modulo 2**64, two
#: words of a thousand a's and b's can have one hash; modulo a prime, as many as anyone would expect by chance.
PRIME_BITS, PRIME = 61, (1 << 61) - 1
WORD_BASE = 0x0B7E151628AED2A7
LOW_BITS = 31


def _reduced(x: np.ndarray) -> np.ndarray:
    """x below 2**64, modulo PRIME."""
    x = (x & U64(PRIME)) + (x >> U64(PRIME_BITS))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**LOW_BITS modulo PRIME, but for a last reduction, of x below PRIME * 2."""
    high = PRIME_BITS - LOW_BITS
    return (x >> U64(high)) + ((x & U64((1 << high) - 1)) << U64(LOW_BITS))


def _word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The low and high bits of WORD_BASE**0 .. WORD_BASE**(n - 1) modulo PRIME; kept for later calls."""
    while len(_POWERS[0]) < n:
        old, factor = _POWERS[0], pow(WORD_BASE, len(_POWERS[0]), PRIME)
        mask = U64((1 << LOW_BITS) - 1)
        low, high = old & mask, old >> U64(LOW_BITS)
        f_low, f_high = U64(factor & ((1 << LOW_BITS) - 1)), U64(factor >> LOW_BITS)
        more = _reduced(high * f_high * U64(2) + _shifted(high * f_low + low * f_high) + low * f_low)
        _POWERS[0] = np.concatenate((old, more))
    own = _POWERS[0][:n]
    return own & U64((1 << LOW_BITS) - 1), own >> U64(LOW_BITS)


_POWERS = [np.ones(1, U64)]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that ``offsets`` cut ``raw`` into; none is empty."""
    sizes = np.diff(offsets)
    if not len(sizes):
        return np.zeros(0, U64)
    at = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    low, high = _word_powers(int(sizes.max()))
    value = raw.astype(U64) + U64(1)
    low, high = (np.add.reduceat(value * p[at], offsets[:-1]) for p in (low, high))
    return mixed(_reduced(_shifted(_reduced(high)) + _reduced(low)) + sizes.astype(U64) * MIX_B)


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, document) of each word; words never cross documents."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    inside = is_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(lower[raw[inside]])]).dictionary_encode()
    h = word_hashes(*flat(coded.dictionary))[coded.indices.to_numpy()]
    return h, start, end, np.searchsorted(offsets, start, "right") - 1


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
