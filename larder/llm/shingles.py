"""Word shingles as 64-bit hashes, computed in whole arrays from a text's bytes."""

from __future__ import annotations

import numpy as np

from larder.llm.common import process_cache

#: Bytes that are hashed at once; longer texts go word-aligned in several parts.
_PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, a random number for each byte (A-Z as a-z), the white space."""
    cache = process_cache("powers")
    if len(cache.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base & _MASK)
            cache[name] = np.multiply.accumulate(out)
        cache["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        cache["byte"][65:91] = cache["byte"][97:123]
        cache["space"] = np.zeros(256, np.int8)
        cache["space"][[32, *range(9, 14)]] = 1
    return cache["up"], cache["down"], cache["byte"], cache["space"]


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word, A-Z lower-cased, words between ASCII white space."""
    return words_of(np.frombuffer(text.encode(), np.uint8))[0]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, and the bytes at which they start and end."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _PART)
        space = _tables(1)[3][data[at:end]]
        if end < len(data) and not space[-1]:  # go on to the end of the word
            rest = _tables(1)[3][data[end:]]
            end += int(rest.argmax()) if rest.any() else len(rest)
            space = _tables(1)[3][data[at:end]]
        up, down, byte, _ = _tables(end - at + 1)
        edges = np.empty(end - at + 1, np.int8)
        edges[0], edges[-1] = space[0] - 1, 1 - space[-1]
        np.subtract(space[1:], space[:-1], out=edges[1:-1])
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum(byte[data[at:end]] * up[: end - at], out=sums[1:])
        parts.append((mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts + at, ends + at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash for each run of `size` words; of fewer words the whole sequence; none without words."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Distinct shingles of a text in ascending order of their hashes."""
    return distinct(shingle_hashes(word_hashes(text), size))


def distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes[np.r_[True, hashes[1:] != hashes[:-1]]] if len(hashes) else hashes
