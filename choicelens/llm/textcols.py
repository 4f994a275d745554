"""Numpy views of Arrow text columns: bytes, words, lines and their hashes.

All functions work on documents laid end to end in one ``uint8`` array with
``n + 1`` offsets, so a batch of many short texts costs the same number of
numpy calls as one long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# FIXED VALUES: the white space that separates words, 0x20 and 0x09-0x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MIX = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string/binary array (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        empty = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = 1 << 20):
    """Ranges [i, j) of consecutive documents of about ``limit`` bytes (one at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def segments(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within each document: starts, ends, document."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(solid))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def words(buf: np.ndarray, off: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of every document: starts, ends, document."""
    return segments(~SPACE[buf], off)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes (equal bytes: equal hash, at any place)."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    total = int(size.sum())
    before = np.cumsum(size) - size
    inside = np.arange(total) - np.repeat(before, size)
    powers = np.multiply.accumulate(np.full(int(size.max()) + 1, _STEP, np.uint64))
    value = _MIX[buf[inside + np.repeat(starts, size)]] * powers[inside]
    full = np.flatnonzero(size)
    h = np.zeros(len(size), np.uint64)
    if len(full):
        h[full] = np.add.reduceat(value, before[full])
    return mixed(h + size.astype(np.uint64) * _STEP)


_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, for ``n`` places at least."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", int(_STEP)), ("down", pow(int(_STEP), -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, from running sums over the buffer (equal bytes: equal hash)."""
    up, down = _powers(len(buf) + 1)
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_MIX[buf] * up[:len(buf)], out=run[1:])
    return mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bit mixer: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by document, as int64."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def by_range(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each document's bytes (bool counts), int64."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[off[1:]] - run[off[:-1]]
