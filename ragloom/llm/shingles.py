"""Word shingles as 64-bit hashes, computed for many texts at once with numpy.

Words are what lies between ASCII white space, A-Z in lower case. A text's set holds its distinct shingles of five
words; with fewer words, the whole sequence as one; without words, nothing.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes hashed at once, and the longest word hashed by the vector path.
PIECE, LONG_WORD = 1 << 19, 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """Lower case; is white space; a random number a byte; powers of an odd base and of its inverse."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    value = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    n = PIECE + LONG_WORD + 1
    powers, inverses = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (np.uint64(base), np.uint64(inverse)))
    return lower, space, value, powers, inverses


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column without nulls, and the offsets of its rows in them."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    lower, space, value, powers, inverses = _tables()
    raw, offsets = text_buffers(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    word = ~space[raw]
    first, final = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    final[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = word[inner]
    final[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    usual = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while at < len(usual):
        low = starts[usual[at]]
        to = max(at + 1, int(np.searchsorted(ends[usual], low + PIECE, side="right")))
        own = usual[at:to]
        s, e = starts[own] - low, ends[own] - low
        sums = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum(value[lower[raw[low : low + e[-1]]]] * powers[: e[-1]], out=sums[1:])
        out[own] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * _ODD)
        at = to
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(lower[raw[starts[k] : ends[k]]].tobytes(), digest_size=8).digest(), "little")
    return out, counts


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text, and their number for each text."""
    words, counts = words_of(texts)
    n = len(texts)
    text = np.repeat(np.arange(n), counts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    ends = np.cumsum(counts)
    total = words * _factor(0)
    for k in range(1, WIDTH):
        total[:-k] += words[k:] * _factor(k)
    whole = np.arange(len(words)) + WIDTH <= np.repeat(ends, counts)
    hashes, owner = mix(total[whole]), text[whole]
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        extra = []
        for k in short.tolist():
            own = words[ends[k] - counts[k] : ends[k]]
            extra.append(sum(int(w) * int(_factor(i)) for i, w in enumerate(own)) + len(own) & (1 << 64) - 1)
        hashes, owner = np.concatenate([hashes, mix(np.array(extra, np.uint64) ^ _ODD)]), np.concatenate([owner, short])
    order = np.argsort(owner.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    h, o = hashes[order], owner[order]
    same = (o[1:] == o[:-1]) & (h[1:] >> np.uint64(20) == h[:-1] >> np.uint64(20))
    if n >= 1 << 20 or np.any(h[1:][same] != h[:-1][same]):  # equal in 44 bits only: order by all of them
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[keep], o[keep]
    return h, np.bincount(o, minlength=n).astype(np.int64)


def _factor(k: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64))
