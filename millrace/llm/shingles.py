"""Vectorised word and shingle hashing over Arrow string columns.

The functions work on the UTF-8 bytes of whole texts, never on prefixes.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z folded
to a-z.  A word hash is a multilinear hash with fixed pseudo-random
coefficients modulo 2**64; a shingle hash mixes the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_APART = np.zeros(256, dtype=bool)
_APART[:128] = [not chr(i).isalnum() for i in range(128)]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser with full avalanche (the splitmix64 output function)."""
    with np.errstate(over="ignore"):
        z = x.astype(U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


_BYTE = mix64(np.arange(256), 101)
_PLACE = [mix64(np.arange(256), 202) | U64(1)]
_STEP = mix64(np.arange(4096), 303) | U64(1)


def _places(n: int) -> np.ndarray:
    if len(_PLACE[0]) < n:
        _PLACE[0] = mix64(np.arange(max(n, 2 * len(_PLACE[0]))), 202) | U64(1)
    return _PLACE[0]


def string_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets from 0) for runs of rows of about ``limit`` bytes.

    A row longer than the limit is a chunk of its own, whole.  Null rows have
    no bytes.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if len(col) == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def text_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for words of ASCII letters and digits and of bytes beyond ASCII."""
    return word_hashes(data, offs, _APART)


def word_hashes(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and for each row the index of its first word (one more entry than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    low = _FOLD[data]
    word = ~apart[low]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offs[1:-1]
    inner = inner[inner < n]
    begin[inner] |= word[inner]
    at = np.flatnonzero(begin)
    if len(at) == 0:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    sizes = np.diff(np.append(at, n))
    place = np.arange(n, dtype=np.int64)
    place[at[0] :] -= np.repeat(at, sizes)
    place[: at[0]] = 0
    with np.errstate(over="ignore"):
        v = _BYTE[low] * _places(int(sizes.max()) + 1)[place]
        v[~word] = 0
        h = mix64(np.add.reduceat(v, at), 7)
    return h, np.searchsorted(at, offs, side="left")


def shingle_sets(col: pa.Array, k: int = 4) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row of fewer than k words has its whole sequence as the one shingle; a
    row without words has none.
    """
    for _, data, offs in string_chunks(col):
        h, first = word_hashes(data, offs)
        with np.errstate(over="ignore"):
            m = len(h) - k + 1
            if m > 0:
                s = np.zeros(m, U64)
                for i in range(k):
                    s += h[i : i + m] * _STEP[i]
                s = mix64(s, 11)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= k:
                    yield np.unique(s[a : b - k + 1])
                elif b > a:
                    yield mix64(np.array([(h[a:b] * _STEP[: b - a]).sum(dtype=U64)]), 12 + b - a)
                else:
                    yield np.zeros(0, U64)


def set_signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = mix64(s, 21).sum(dtype=U64), mix64(s, 22).sum(dtype=U64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
