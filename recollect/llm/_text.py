"""Words and their 64-bit hashes, for whole Arrow batches of texts at once (numpy only)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U64 = np.uint64
#: Text bytes handled at once; a longer document is handled alone, whole.
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes hashed at once: the tables of powers are this long, whatever the length of a text.
_BLOCK = 1 << 17


def _powers(base: int) -> np.ndarray:
    x = np.full(_BLOCK + 1, base, U64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_P), _powers(_PINV)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def texts(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. What the batch before has used is given back first."""
    give_back()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int32 if pa.types.is_string(col.type) else np.int64)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Longest runs of whole documents within limit bytes, or one larger document and the empty ones after it: (first, last, bytes, offsets)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, max(offsets[i] + limit, offsets[i + 1]), "right")) - 1
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each document, and where each document's words begin (length: documents + 1)."""
    n = len(data)
    cuts = np.unique(offsets)
    starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(0, n, CHUNK_BYTES):  # in steps, so that a very long document takes no more than its own bytes and words
        hi = min(n, lo + CHUNK_BYTES)
        word = np.zeros(hi - lo + 2, bool)  # from the byte before lo to the byte after the last
        a, b = max(lo - 1, 0), min(hi + 1, n)
        word[a - lo + 1 : b - lo + 1] = ~SPACE[data[a:b]]
        here, before, after = word[1:-1], word[:-2].copy(), word[2:].copy()
        inner = cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi, "right")] - lo
        before[inner[inner < hi - lo]] = False
        after[inner[inner > 0] - 1] = False
        starts.append(np.flatnonzero(here & ~before) + lo)
        ends.append(np.flatnonzero(here & ~after) + lo + 1)
    first = np.concatenate(starts)
    return first, np.concatenate(ends), np.searchsorted(first, offsets)


def span_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that follow each other without overlap; polynomials over the places in a span, in blocks of fixed size."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    sums = np.zeros(_BLOCK + 1, U64)
    while i < n:
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _BLOCK, "right"))
        if j <= i:
            out[i] = _long_hash(lowered[base : int(ends[i])])
            i += 1
            continue
        block = lowered[base : int(ends[j - 1])]
        np.cumsum(_BYTE[block] * _UP[: len(block)], out=sums[1 : len(block) + 1])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * _DOWN[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def _long_hash(span: np.ndarray) -> np.uint64:
    total, mask = 0, (1 << 64) - 1
    for lo in range(0, len(span), _BLOCK):
        block = span[lo : lo + _BLOCK]
        total += int((_BYTE[block] * _UP[: len(block)]).sum(dtype=U64)) * pow(_P, lo, 1 << 64)
    return U64(total & mask)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word windows of each document and where each document's windows begin.

    A document of fewer words gives its whole sequence as one window, one without words gives none.
    """
    n = np.diff(bounds)
    h = np.concatenate([hashes, np.zeros(size, U64)])
    w = np.zeros(len(hashes), U64)
    factor = 1
    for j in range(size):
        w += h[j : j + len(hashes)] * U64(factor)
        factor = factor * 0xA24BAED4963EE407 % (1 << 64)
    w = mix(w)
    keep = np.ones(len(hashes), bool)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(hashes)) - bounds[:-1][doc]
    keep = at < count[doc]
    for i in np.flatnonzero((n > 0) & (n < size)):
        s, f, x = int(bounds[i]), 1, int(n[i])
        with np.errstate(over="ignore"):
            for j in range(int(n[i])):
                x = (x + int(hashes[s + j]) * f) % (1 << 64)
                f = f * 0xC2B2AE3D27D4EB4F % (1 << 64)
        w[s] = mix(np.array([x], U64))[0]
    return w[keep], np.concatenate([[0], np.cumsum(count)])
