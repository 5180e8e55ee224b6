"""Word shingles of a text as 64-bit hashes, computed with numpy on its UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, after A-Z
became a-z; both tests concern ASCII only, so bytes do as well as characters.
A word's hash is a polynomial in an odd base modulo 2**64, taken from running
sums; a shingle's is a mixed combination of five word hashes.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += np.uint64(32)
_VALUE = _lower + np.uint64(1)
_WORD = np.ones(256, dtype=np.int8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_PLACE = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _chunk_words(data: np.ndarray) -> np.ndarray:
    up, down = _tables(len(data) + 1)
    inside = _WORD[data]
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text) -> np.ndarray:
    """Hashes of the words of a text given as a buffer of UTF-8 bytes."""
    data = np.frombuffer(text, np.uint8) if len(text) else np.empty(0, np.uint8)
    if len(data) <= CHUNK:
        return _chunk_words(data)
    parts, at = [], 0
    while at < len(data):  # cut at white space; a word longer than a chunk stays whole
        end = at + CHUNK
        while end < len(data) and not (gap := np.flatnonzero(_WORD[data[end : end + CHUNK]] == 0)).size:
            end += CHUNK
        end = end + int(gap[0]) if end < len(data) else len(data)
        parts.append(_chunk_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer than five words are one shingle."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        return mixed(np.array([int(np.sum(words * _PLACE[:n], dtype=np.uint64)) ^ n], np.uint64))
    total = words[: n - WIDTH + 1] * _PLACE[0]
    for i in range(1, WIDTH):
        total = total + words[i : n - WIDTH + 1 + i] * _PLACE[i]
    return np.unique(mixed(total))
