"""Vectorised text primitives on Arrow string buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. All these bytes are ASCII, so words are cut on the
UTF-8 bytes. Hashes are 64-bit polynomials of the bytes, mixed; they depend on the
bytes alone. Work goes on in slices of a few MB whatever the size of a batch or text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together (a longer text is a slice of its own).
SLICE_BYTES = 1 << 21
_BLOCK = 1 << 22

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)
_INV = _U(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True



class _Cache(dict):
    """Travels to executors empty."""

    def __reduce__(self):
        return _Cache, ()


_POWERS: dict[str, np.ndarray] = _Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE)
            up[0] = 1
            down = np.full(size, _INV)
            down[0] = 1
            _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three xor-shifts, two multiplications)."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def slices(offs: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most ``most`` bytes, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word
    (one entry more than rows). ``offs`` starts at 0 and ends at ``len(data)``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~SPACE[data]
    begin, stop = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    stop[:-1] &= ~ink[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    begin[first] = ink[first]
    stop[last] = ink[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _poly(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
        return (total[ends] - total[starts]) * down[starts]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (sorted, apart), in blocks of bounded size."""
    if len(data) <= _BLOCK:
        raw = _poly(data, starts, ends)
    else:
        raw, k = np.zeros(len(starts), _U), 0
        while k < len(starts):
            at = starts[k]
            m = int(np.searchsorted(ends, at + _BLOCK, "right"))
            if m > k:
                raw[k:m] = _poly(data[at : ends[m - 1]], starts[k:m] - at, ends[k:m] - at)
                k = m
            else:  # one word beyond a block: by parts
                value, shift = _U(0), _U(1)
                with np.errstate(over="ignore"):
                    for b in range(int(at), int(ends[k]), _BLOCK):
                        part = data[b : min(b + _BLOCK, int(ends[k]))]
                        value += _poly(part, np.array([0]), np.array([len(part)]))[0] * shift
                        shift *= _U(pow(int(_BASE), len(part), 1 << 64))
                raw[k], k = value, k + 1
    with np.errstate(over="ignore"):
        return mix64(raw + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for j in range(size):
            out += words[j : j + n] * _U(pow(int(_BASE), j + 1, 1 << 64))
        return mix64(out ^ _U(salt))


def rolling_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """As gram_hashes, by prefix sums: for long runs."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, _U)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix64(((total[size:] - total[:-size]) * down[:n]) ^ _U(salt))


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and the row of each. A row of 1 to size - 1 words has
    one shingle, all its words; a row without words has none."""
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    grams = gram_hashes(words, size)
    if len(grams):
        inside = rows[: len(grams)] == rows[size - 1 :]
        grams, owner = grams[inside], rows[: len(inside)][inside]
    else:
        owner = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        with np.errstate(over="ignore"):
            at = np.arange(len(words)) - first[rows]
            up, _ = _powers(size + 1)
            each = np.where(counts[rows] < size, words * up[np.minimum(at, size - 1) + 1], _U(0))
            total = np.concatenate([np.zeros(1, _U), np.cumsum(each, dtype=_U)])
            extra = mix64((total[first[short + 1]] - total[first[short]]) ^ counts[short].astype(_U))
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values within each row, their rows and how often each occurred."""
    if not len(values):
        return values, rows, np.zeros(0, np.int64)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return v[at], r[at], np.diff(np.append(at, len(v)))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers, for Spark's long."""
    return x.view(np.int64)
