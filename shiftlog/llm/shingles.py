"""Sets of five-word shingle hashes of many texts, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at a time: bounds the working memory, whatever the text.
SLICE = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2 ** 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2 ** 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the input reaches every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a slice."""
    raw = np.frombuffer(data, np.uint8)
    word = ~_BLANK[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    length = ends - starts
    first = np.concatenate([[0], length.cumsum()[:-1]])
    place = np.arange(length.sum()) - np.repeat(first, length)
    power = np.full(int(length.max()), _BASE).cumprod(dtype=np.uint64)
    sums = np.add.reduceat(_BYTE[raw[word]] * power[place], first)
    return _mix(sums + length.astype(np.uint64)), starts


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word (bytes other than white space)."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        h, s = _hash_words(data[at:end])
        hashes.append(h)
        firsts.append(s + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([*hashes, none.astype(np.uint64)]), np.concatenate([*firsts, none])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z in lower case; a text
    of fewer words has its whole sequence as one, one without words none."""
    out, held, size = [], [], 0
    for text in texts:
        data = text.encode().translate(_LOWER)
        held.append(data)
        size += len(data)
        if size >= SLICE:
            out += _sets(held)
            held, size = [], 0
    return out + _sets(held)


def _sets(parts: list[bytes]) -> list[np.ndarray]:
    if not parts:
        return []
    hashes, firsts = hash_words(b"\n".join(parts))
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    at = np.searchsorted(firsts, begins)
    sums = np.zeros(len(hashes), np.uint64)
    for k in range(min(WORDS, len(sums) + 1)):
        sums[:len(sums) - k] += hashes[k:] * _PLACE[k]
    sums = _mix(sums)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= WORDS:
            out.append(np.unique(sums[a:b - WORDS + 1]))
        elif b > a:
            whole = (hashes[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
