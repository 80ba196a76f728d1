"""Sets of hashed word shingles of whole texts, computed over whole Arrow buffers with numpy.

Words are runs outside [\\x20\\x09-\\x0D], with A-Z lower-cased. A word's hash is a polynomial over its bytes
(each mapped to a random odd 64-bit number) modulo 2**64, read off prefix sums; a shingle's hash combines
its words' hashes. Two different shingles collide with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = mix(np.arange(1, 257, dtype=U) * _ODD) | U(1)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return value, space


VALUE, SPACE = _tables()
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = U(pow(int(_ODD), -1, 1 << 64))
        for i, base in enumerate((_ODD, inverse)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its documents' edges; null is empty."""
    column = column.fill_null("").cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), edges


def words_of(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, document after the last, words' documents counted from the first, words' hashes, begins, ends) for blocks of whole documents."""
    a, n = 0, len(edges) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + BLOCK, "right")) - 1)
        part, own = data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        ink = ~SPACE[part]
        begins, ends = ink.copy(), ink.copy()
        inner = own[1:-1]
        inner = inner[inner < len(part)]
        begins[1:] &= ~ink[:-1]
        begins[inner] |= ink[inner]
        ends[:-1] &= ~ink[1:]
        inner = inner[inner > 0]
        ends[inner - 1] |= ink[inner - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(VALUE[part] * up[: len(part)], out=total[1:])
        h = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * _ODD)
        yield a, b, np.searchsorted(own, s, "right") - 1, h, s + edges[a], e + edges[a]
        a = b


def word_hashes(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, words' documents counted from it, words' hashes) for blocks of whole documents."""
    for a, _, owner, h, _, _ in words_of(data, edges):
        yield a, owner, h


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes; with fewer words the whole sequence is one; without words none."""
    data, edges = buffers(column)
    n = len(edges) - 1
    at = 0
    for first, owner, h in word_hashes(data, edges):
        grams = np.zeros(max(0, len(h) - words + 1), U)
        for j in range(words):
            grams = mix(grams * _ODD + h[j : j + len(grams)])
        whole = owner[words - 1 :] == owner[: len(grams)] if len(grams) else np.zeros(0, bool)
        grams, gram_owner = grams[whole], owner[: len(whole)][whole]
        last = first + (int(np.searchsorted(edges, edges[first] + BLOCK, "right")) - 1 - first if n else 0)
        last = max(first + 1, last)
        size = last - first
        cut = np.searchsorted(gram_owner, np.arange(size + 1))
        word_cut = np.searchsorted(owner, np.arange(size + 1))
        for d in range(size):
            if cut[d + 1] > cut[d]:
                yield np.unique(grams[cut[d] : cut[d + 1]])
            elif word_cut[d + 1] > word_cut[d]:
                one = np.zeros(1, U)
                for w in h[word_cut[d] : word_cut[d + 1]]:
                    one = mix(one * _ODD + w)
                yield one
            else:
                yield np.zeros(0, U)
            at += 1
    while at < n:
        at += 1
        yield np.zeros(0, U)
