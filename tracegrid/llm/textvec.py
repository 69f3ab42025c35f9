"""Words and shingles of whole batches of texts, as numpy arrays over Arrow's own buffers.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased
text. No text becomes a Python string: Arrow lower-cases the column, and hashes are computed from
prefix sums over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = U64(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 21

IS_WORD = np.zeros(256, bool)
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[128:] = True

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES)
        for base, name in ((_BASE, "_powers"), (_INVERSE, "_inverses")):
            steps = np.full(n, base, U64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=U64)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing mix of a 64-bit hash."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column of about ``limit`` bytes; a longer text gets a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, column.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, column.slice(start)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one after the other, and where each row starts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ptr = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ptr[0] : ptr[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ptr - ptr[0]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return raw(pc.utf8_lower(pc.fill_null(column, "") if column.null_count else column))


def word_spans(data: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words start. Words never cross rows."""
    n = len(data)
    inside = IS_WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = ptr[(ptr > 0) & (ptr < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, ptr)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans are ordered by start and reach no further than 2^21 bytes at once."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + CHUNK_BYTES)))
        stop = int(ends[i:j].max())
        pw, inv = powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, U64)
        np.cumsum((data[base:stop].astype(U64) + U64(1)) * pw[: stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(U64) * U64(_BASE)
        i = j
    return mix(out)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and where each row's words start."""
    data, ptr = lowered(column)
    starts, ends, wptr = word_spans(data, ptr)
    return span_hashes(data, starts, ends), wptr


def shingles(words_: np.ndarray, wptr: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and where each row's runs start."""
    counts = np.maximum(np.diff(wptr) - k + 1, 0)
    sptr = np.concatenate([[0], np.cumsum(counts)])
    n = len(words_) - k + 1
    if n <= 0 or sptr[-1] == 0:
        return np.zeros(0, U64), sptr
    s = words_[:n].copy()
    for j in range(1, k):
        s *= _SHINGLE
        s += words_[j : j + n]
    row = np.repeat(np.arange(len(wptr) - 1), np.diff(wptr))[:n]
    return mix(s[np.arange(n) + k <= wptr[row + 1]]), sptr


def with_occurrence(s: np.ndarray, sptr: np.ndarray) -> np.ndarray:
    """Each shingle joined with the number of its earlier occurrences in its row, counted in text order."""
    if len(s) < 2:
        return s
    row = np.repeat(np.arange(len(sptr) - 1), np.diff(sptr)).astype(U64)
    key = mix(s + row * U64(_BASE))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return s
    twice = np.unique(twice)
    slot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    at = np.flatnonzero(twice[slot] == key)
    at = at[np.argsort(key[at], kind="stable")]
    k = key[at]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.flatnonzero(first)
    nth = np.arange(len(k)) - np.repeat(starts, np.diff(np.append(starts, len(k))))
    out = s.copy()
    out[at] = np.where(nth > 0, mix(s[at] + nth.astype(U64) * U64(0xA0761D6478BD642F)), s[at])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
