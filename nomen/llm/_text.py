"""Vectorised text helpers used inside Arrow tasks.

Texts are taken as UTF-8 bytes straight from the Arrow buffers. Words are runs
of bytes outside ``[\\x20\\x09-\\x0D]``; as these are ASCII bytes, byte runs and
character runs agree. Rows are handled in slices of about ``SLICE_BYTES`` so
that the temporary arrays of a task stay bounded whatever the batch size (a
single longer text forms a slice of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_MULT = 0x9E3779B97F4A7C15  # odd: invertible modulo 2**64
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept per process, grown by doubling)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        m = max(1024, 1 << int(n - 1).bit_length()) if n > 1 else 1024
        have = np.full(m, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if m <= (SLICE_BYTES << 2):
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n+1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, off


def slices(data: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES):
    """(first row, row after the last, bytes, offsets from 0) of consecutive rows."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a slice."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = ~WHITE[data]
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    first = off[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    last = off[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def prefix_hash(data: np.ndarray, base: int = _MULT) -> np.ndarray:
    """Running polynomial hash (length n+1) for :func:`span_hash`."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=h[1:], dtype=np.uint64)
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _MULT) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes, equal hash."""
    inv = powers(inverse(base), len(h))
    raw = (h[ends] - h[starts]) * inv[starts]
    return mix64(raw ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hash(values: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each run of ``k`` consecutive uint64 values (length n-k+1)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=h[1:], dtype=np.uint64)
    return mix64((h[k:] - h[:-k]) * powers(inverse(base), n)[: n - k + 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start+length-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
