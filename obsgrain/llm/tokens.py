"""Words and word shingles as 64-bit numbers, computed over Arrow buffers without a Python loop per word."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words for classifiers: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hash of each maximal run of bytes marked in `inside`, and each text's first word (one entry more than texts).

    With `prefix`, a third array: the hash of each word's first so many bytes (of the whole word, if it is shorter).
    """
    none = (np.empty(0, np.uint64), np.zeros(len(offs), np.int64), np.empty(0, np.uint64))[: 3 if prefix else 2]
    if not data.size:
        return none
    word = inside[data]
    prev = np.empty_like(word)
    prev[0] = False
    prev[1:] = word[:-1]
    prev[offs[:-1][offs[:-1] < data.size]] = False
    starts = np.flatnonzero(word & ~prev)
    if not starts.size:
        return none
    head = int(starts[0])
    spans = np.diff(np.append(starts, data.size))
    rel = np.arange(head, data.size) - np.repeat(starts, spans)
    # runs end where the marked bytes do; what follows adds nothing to a run's sum
    value = np.where(word[head:], data[head:].astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers(int(rel.max()) + 1)[rel]
    out = mix(np.add.reduceat(value, starts - head)), np.searchsorted(starts, offs)
    return (*out, mix(np.add.reduceat(np.where(rel < prefix, value, np.uint64(0)), starts - head))) if prefix else out


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words and each one's text. A text of fewer words is one shingle; one of none has none."""
    n, count = len(hashes), np.diff(first)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    left = np.repeat(first[1:], count) - np.arange(n)  # words from here to the text's end
    whole = np.repeat(count, count)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    total = np.zeros(n, np.uint64)
    weight = powers(size + 1, np.uint64(0xD6E8FEB86659FD93))
    for j in range(size):
        total += np.where(left > j, padded[j : j + n], np.uint64(0)) * weight[j + 1]
    use = (left >= size) | ((whole < size) & (left == whole))
    return mix(total[use]), np.repeat(np.arange(len(count)), count)[use]
