"""64-bit hashes of all words of a batch of texts at once, over the batch's UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed by itself.
CHUNK = 2 << 20

#: The C library's own call, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_DRAW = np.random.default_rng(20240501)
_ODD = (_DRAW.integers(0, 1 << 63, 16, dtype="u8") << np.uint64(1)) | np.uint64(1)
_LETTERS = _DRAW.integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + _DRAW.integers(0, 2, 256, dtype="u8")
_BASE = _ODD[0]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[bool, np.ndarray] = {}
# Words are what stands between these: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A to Z hash like a to z.
_LETTERS[ord("A"):ord("Z") + 1] = _LETTERS[ord("a"):ord("z") + 1]


def _powers(n: int, inverse: bool) -> np.ndarray:
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK), _INVERSE if inverse else _BASE, "u8")
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= CHUNK:
            _POWERS[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts ``data[offsets[i]:offsets[i + 1]]``, and where each text's begin."""
    n = len(data)
    if n == 0:
        return np.zeros(0, "u8"), np.zeros(len(offsets), "i8")
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, "u8")
    np.cumsum(np.where(inside, _LETTERS[data] * _powers(n, False), np.uint64(0)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(n, True)[starts]
    return mix(hashes + (ends - starts).astype("u8") * _ODD[1]), np.searchsorted(starts, offsets)


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for words in order; depends on their number."""
    out = np.full(len(hashes[0]), len(hashes), "u8") * _ODD[2]
    for i, h in enumerate(hashes):
        out = out + h * _ODD[3 + i]
    return mix(out)


def give_back() -> None:
    """Return what freed arrays and batches still hold to the system: workers stay for other stages beside a full JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_chunks(texts: pa.Array, times: float = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a string column of about ``times * CHUNK`` bytes: first row, bytes, rows' offsets. Null is empty."""
    texts = texts.fill_null("")
    wide = texts.type == pa.large_string()
    offsets = np.frombuffer(texts.buffers()[1], "i8" if wide else "i4")[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype("i8") if len(texts) else np.zeros(1, "i8")
    body = texts.buffers()[2]
    data = np.frombuffer(body, "u1") if body is not None else np.zeros(0, "u1")
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + int(times * CHUNK), "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words, of all as one; of none, nothing."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    return np.unique(combine([words[i:i + n] for i in range(size)]))
