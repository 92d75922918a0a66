"""Words and shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Words and shingles are 64-bit
hashes: two different ones agree with probability near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

_rng = np.random.default_rng(20240607)
_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=_U)[_LOWER]
_STEP = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_tables = [np.ones(1, _U), np.ones(1, _U)]


_press, _unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def press(x: np.ndarray) -> bytes:
    """Bytes by place (all lowest first), compressed: small numbers then take little."""
    x = np.ascontiguousarray(x)
    return _press.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) if len(x) else b""


def unpress(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    raw = np.frombuffer(_unpress.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, by position."""
    global _tables
    if len(_tables[0]) < n:
        n = max(n, 1 << 21) + 1
        _tables = [np.concatenate([[_U(1)], np.cumprod(np.full(n, x, _U), dtype=_U)]) for x in (_STEP, _INVERSE)]
    return _tables


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about `most` bytes, with the row each begins at; a longer text is a slice of its own."""
    n, at = len(texts), 0
    _, offs = raw(texts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def words(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple:
    """Hash of every word, and for each row where its words begin (one more entry at the end).

    With prefixes, a third item holds for each length the hashes of the words' first so many bytes.
    """
    data, offs = raw(texts)
    start, end = _edges(data, offs)
    if not len(start):
        none = np.zeros(0, _U)
        return (none, np.zeros(len(offs), np.int64), *([[none] * len(prefixes)] if prefixes else []))
    power, inverse = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    if not prefixes:
        return mix(h), np.searchsorted(start, offs)
    heads = [mix((total[np.minimum(start + k, end)] - total[start]) * inverse[start] + _U(k)) for k in prefixes]
    return mix(h), np.searchsorted(start, offs), heads


def _edges(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a row's end also ends its last word. sep: for each byte, whether it parts words."""
    solid = ~sep[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    start[first] = solid[first]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | start[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def count_words(texts: pa.Array) -> np.ndarray:
    """Number of words of each row."""
    data, offs = raw(texts)
    return np.diff(np.searchsorted(_edges(data, offs)[0], offs))


def shingles(h: np.ndarray, ptr: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """n-word shingles (with repeats) of rows given by words(), and where each row's begin.

    A row of 1 to n-1 words has its whole sequence as the one shingle; a row without words has none.
    """
    size = np.diff(ptr)
    m = max(0, len(h) - n + 1)
    full = h[:m].copy()
    for k in range(1, n):
        full = mix(full) * _STEP + h[k : m + k]
    full = mix(full)
    own = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out_ptr = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(out_ptr[-1], _U)
    long = size >= n
    if long.any():
        lens = own[long]
        at = np.repeat(ptr[:-1][long], lens) + _ramp(lens)
        to = np.repeat(out_ptr[:-1][long], lens) + _ramp(lens)
        out[to] = full[at]
    for i in np.flatnonzero((size > 0) & ~long):
        x = _U(size[i])
        for w in h[ptr[i] : ptr[i + 1]]:
            x = _short(x, w)
        out[out_ptr[i]] = x
    return out, out_ptr


def _short(x: np.uint64, w: np.uint64) -> np.uint64:
    return mix(mix(np.array([x], _U)) * _STEP + w)[0]


def _ramp(lens: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lens, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each row."""
    out: list[np.ndarray] = []
    for _, part in pieces(texts):
        s, ptr = shingles(*words(part), n)
        out += [np.unique(s[a:b]) for a, b in zip(ptr[:-1], ptr[1:])]
    return out
