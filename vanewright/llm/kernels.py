"""Vectorised text kernels that run inside Arrow tasks: words, fingerprints of spans, window minima.

All of them work on a slice of a batch: the UTF-8 bytes of some documents laid end to end, and the
offsets between them. Nothing crosses a document's end.

Rolling hashes choose places; fingerprints tell things apart. What is removed or reused on the word of a fingerprint
takes SHA-256 or the bytes themselves besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one slice holds (a longer document is a slice of its own).
SLICE_BYTES = 1 << 20
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Seeds of independent fingerprints, and the multiplier of a pair's second code.
LANES = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344))
PAIR = U64(0xA4093822299F31D1)
#: Places in a span whose values are kept in a table.
PLACES = 64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2^64; grown as needed."""
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 1 << 16, min(2 * len(have), 1 << 22))
        step = BASE if kind == "up" else BASE_INVERSE
        have = np.full(size, step, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    where = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), where


def slices(where: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(where) - 1
    while i < n:
        j = int(np.searchsorted(where, where[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each slice of a column."""
    data, where = flat(column)
    for i, j in slices(where, most):
        yield i, j, data[where[i] : where[j]], where[i : j + 1] - where[i]


def words(buf: np.ndarray, where: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ (or between other separators), and each row's first word (one
    more entry than rows)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(where), np.int64)
    gap = separators[buf]
    inside = ~gap
    start, end = inside.copy(), inside.copy()
    start[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    first = where[:-1][where[:-1] < n]
    start[first] = inside[first]
    last = where[1:][where[1:] > 0] - 1
    end[last] = inside[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, where)


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of the base: a polynomial of every prefix, modulo 2^64."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers("up", len(values)), out=out[1:])
    return out


def rolling_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A rolling hash of every k consecutive codes. Equal runs have equal ones, and different runs may too (there are
    texts made so that they do), so it may decide where things meet, never that they are equal."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    prefix = running(codes)
    return mix((prefix[k:] - prefix[:n]) * powers("down", n) + U64(k))


@lru_cache(None)
def place_values(lane: int) -> np.ndarray:
    """The value of a byte at each of the first PLACES places of a span, by place * 256 + byte."""
    return mix(np.arange(PLACES << 8, dtype=U64) * BASE + LANES[lane])


def span_codes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit fingerprints of spans of bytes, in order and without overlaps. Every pair of a byte and its place in the
    span has a scrambled value of its own, and a span has their sum, so no structure of a text carries over to it. Lanes
    are independent of each other: two make 128 bits."""
    n, some = len(buf), e > s
    kind = np.int32 if n < 1 << 31 else np.int64
    begin = np.zeros(n, kind)
    begin[s[some]] = s[some]
    place = np.arange(n, dtype=kind) - np.maximum.accumulate(begin)
    at = np.minimum(place, kind(PLACES - 1)) << kind(8) | buf
    values = place_values(lane)[at]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        values[far] = mix((place[far].astype(U64) << U64(8) | buf[far]) * BASE + LANES[lane])
    total = np.zeros(n + 1, U64)
    np.cumsum(values, out=total[1:])
    return mix(total[e] - total[s] + (e - s).astype(U64) * LANES[lane])


def word_codes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lane: int = 0) -> np.ndarray:
    return span_codes(buf, s, e, lane)


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A code of each pair of codes, in this order; scrambled again, so that codes of codes keep no structure."""
    return mix(a * BASE + b * PAIR)


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every k consecutive codes, by where they start; the caller drops those over an end. Codes of 1,
    2, 4, ... are joined in pairs, the last pair overlapping where k is no power of two."""
    if len(codes) < k:
        return np.zeros(0, U64)
    have, size = codes, 1
    while size < k:
        step = min(size, k - size)
        have = joint(have[:-step], have[step:])
        size += step
    return mix(have ^ U64(k))


def starts_within(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n - k + 1 starts keep k items within one row; first: each row's first item."""
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    counts = np.diff(first)
    end = np.repeat(first[1:], counts)[:m]
    return np.arange(k, k + m) <= end


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(codes: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive codes, where the least lies: the last one of equals. Equal runs of codes have
    it at the same place, which is what brings equal windows together without comparing all."""
    low = (U64(1) << U64(31)) - U64(1)  # as Spark's rows end at 2^31 bytes, any place fits
    least = sliding_min((codes & ~low) | (low - np.arange(len(codes), dtype=U64)), w)
    return (low - (least & low)).astype(np.int64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] values, then the same for the next."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return np.arange(total, dtype=np.int64) + shift


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
