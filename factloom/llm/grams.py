"""Vectorised word n-gram hashing over Arrow string batches.

A token is a maximal run of bytes other than ASCII white space (space, tab, newline, carriage return, form feed,
vertical tab) of the *lower-cased* text; lower-casing happens in the JVM before the batch reaches Python.  An n-gram
is n consecutive tokens; a text of 1..n-1 tokens has one gram, all its tokens; an empty text has none.  Everything is
done on whole Arrow buffers, so the cost is a few array passes over the bytes and never a Python loop per token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16
_BLOCK_BYTES = 2 << 20
_GROUP_TOKENS = 400_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective, so it never adds collisions)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> np.ndarray:
    """_BASE ** 0, 1, 2, ... modulo 2**64 (n of them at least)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK)
        p = np.full(size, _BASE, dtype=U)
        p[0] = 1
        _POWERS[:] = [np.multiply.accumulate(p)]
    return _POWERS[0]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls; offsets[0] is 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def _block_tokens(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the tokens of a block; rows start at `edges`."""
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[edges] = solid[edges]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, U), start
    # a token ends where the next byte is white space or belongs to another row
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    length = np.flatnonzero(last) + 1 - start
    # polynomial hash of each token: sum of byte * BASE ** (position in token)
    power = _powers(int(length.max()))
    body = np.flatnonzero(solid)
    value = (raw[body].astype(U) + U(1)) * power[body - np.repeat(start, length)]
    h = np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1])))
    return mix64(h ^ (length.astype(U) << U(56))), start


def token_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every token, and for every row the index of its first token (length rows + 1).

    Works in blocks of about _BLOCK_BYTES that end at a row's end or at white space, so memory beyond the result doesn't
    grow with the batch or with a document.
    """
    edges = np.unique(offsets[:-1][offsets[:-1] < len(raw)])
    hashes, starts, a = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while a < len(raw):
        b = a + _BLOCK_BYTES
        if b < len(raw):
            k = np.searchsorted(edges, b, side="right") - 1
            if edges[k] > a:
                b = int(edges[k])
            else:
                while b < len(raw) and not len(gap := np.flatnonzero(_SPACE[raw[b : b + _BLOCK]])):
                    b += _BLOCK
                b = min(len(raw), b + int(gap[0])) if b < len(raw) else len(raw)
                k = np.searchsorted(edges, b, side="right") - 1
                b = int(edges[k]) if edges[k] > a else b
        b = min(b, len(raw))
        h, start = _block_tokens(raw[a:b], edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a)
        hashes.append(h)
        starts.append(start + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def gram_hashes(tokens: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams (repeated ones too) and the row of each."""
    count = np.diff(rows)
    k = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), k)
    first = np.repeat(rows[:-1] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(len(row))
    stop = rows[1:][row]
    h = np.zeros(len(row), U)
    factor = 0x9E3779B97F4A7C15
    for i in range(n):
        at = first + i
        inside = at < stop
        part = tokens[np.minimum(at, len(tokens) - 1)] * U(factor)
        h += np.where(inside, part, U(0)) if not inside.all() else part
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mix64(h), row


def gram_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of every row: (hashes, bounds), those of row i are hashes[bounds[i]:bounds[i+1]], ascending."""
    offsets, raw = string_buffers(col)
    rows = len(offsets) - 1
    tokens, at = token_hashes(offsets, raw)
    if not len(tokens):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    # Groups of rows with about _GROUP_TOKENS tokens each bound the memory of the intermediate arrays.
    out, count, a = [], np.zeros(rows, np.int64), 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + _GROUP_TOKENS)))
        b = min(b, rows)
        h, row = gram_hashes(tokens[at[a] : at[b]], at[a : b + 1] - at[a], n)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            h[bounds[i] : bounds[i + 1]].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        out.append(h[keep])
        count[a:b] = np.bincount(row[keep], minlength=b - a)
        a = b
    return np.concatenate(out), np.concatenate(([0], np.cumsum(count)))


def squeeze(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte by byte of its elements (their high bytes are mostly alike)."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unsqueeze(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def ascending(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def from_ascending(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, kind), dtype=kind)
