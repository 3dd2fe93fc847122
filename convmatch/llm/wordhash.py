"""Vectorised word hashing shared by the operators on word sequences.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, the same words as
``bytes.split()`` gives.  Its hash is a polynomial over a fixed random byte table modulo
2**64, so equal words have equal hashes in every task and on every machine.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, dtype=np.int8)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are hashed in pieces of about this many bytes, cut between words.
_CHUNK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 15)
        ones = np.ones(size, dtype=np.uint64)
        up, down = ones * _BASE, ones * _BASE_INV
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words start and end."""
    edge = np.diff(_SPACE[buf], prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """uint64 hash of every word of ``text``, in order.  ``lower`` folds A-Z first."""
    buf = np.frombuffer(text, dtype=np.uint8)
    if len(buf) == 0:
        return np.empty(0, dtype=np.uint64)
    if lower:
        buf = _LOWER[buf]
    starts, ends = word_spans(buf)
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _CHUNK, side="right")))
        at, to = int(starts[lo]), int(ends[hi - 1])
        up, down = _tables(to - at + 1)
        total = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[at:to]] * up[: to - at], out=total[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """uint64 hash of every run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _BASE + words[j : j + n]
    return mix(h)


def span_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """uint64 hash of the words ``first`` to ``end`` (exclusive) of each span; one pass for all."""
    out, lo = np.empty(len(first), dtype=np.uint64), 0
    while lo < len(first):  # spans start in order; the powers are kept for a million words
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + _CHUNK // 2)))
        at, to = int(first[lo]), int(end[lo:hi].max())
        up, down = _tables(to - at + 1)
        total = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(words[at:to] * up[: to - at], out=total[1:])
        s, e = first[lo:hi] - at, end[lo:hi] - at
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    # doubling: the best position of 2**i values from each place on
    best, span = np.arange(len(values)), 1
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def batches_of_texts(texts, limit: int = 1 << 19):
    """Slices (lo, hi, buffer, offsets) of an Arrow string array with about ``limit`` bytes each.

    The buffer is the slice's text, joined; offsets say where each text starts, and the last
    one where the slice ends.  Null texts are empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    bufs = texts.buffers()
    at = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def text_word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of joined texts, as :func:`word_hashes` gives for each, and the number of
    words before each text (one more entry than texts)."""
    if len(offsets) == 2 and len(buf) > _CHUNK:
        h = word_hashes(buf.tobytes(), lower)
        return h, np.array([0, len(h)])
    if len(buf) == 0:
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    if lower:
        buf = _LOWER[buf]
    solid = _SPACE[buf] == 0
    begins = np.zeros(len(buf) + 1, dtype=bool)
    begins[offsets] = True
    before = np.empty(len(buf), dtype=bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | begins[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | begins[1:])) + 1
    up, down = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)
