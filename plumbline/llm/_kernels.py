"""Array kernels over UTF-8 bytes: words, hashes, pre-tokens.

Texts are handled as one byte buffer with offsets, so that the cost per byte
is a few array operations and no Python object is made per word.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

U64 = np.uint64
_SEED = np.random.default_rng(20240229)
_BYTE_KEY = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_SHINGLE_KEY = _SEED.integers(1, 2**63, 16, dtype=np.uint64) | U64(1)

#: Bytes that part words: space and the controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[name] = have = np.multiply.accumulate(table)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from one running sum over the buffer.

    The sum of key[b] * base**i over a span, times base**-start, depends on the
    bytes alone and not on the place.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_KEY[raw] * _power_table("up", _BASE, len(raw)), out=total[1:])
    h = (total[ends] - total[starts]) * _power_table("down", _BASE_INV, len(raw) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without SPACES; ``bounds`` are the places
    where a new text starts, which also end a word."""
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~SPACES[raw]
    start = word[1:] & ~word[:-1]
    end = word[:-1] & ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    inner = inner[word[inner] & word[inner + 1]]
    start[inner] = True
    end[inner] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words; with fewer words, one of them all."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, U64(width), np.uint64)
    for i in range(width):
        h += words[i : n - width + 1 + i] * _SHINGLE_KEY[i]
    return mix(h)


# ------------------------------------------------------------- pre-tokens

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4
#: Code points with the Unicode property White_Space (fixed values).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER}
    for cp in range(sys.maxunicode + 1):
        k = kinds.get(unicodedata.category(chr(cp))[0])
        if k:
            table[cp] = k
    table[_WHITE] = _SPACE
    return table


def _byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _classes()
    cls = table[np.minimum(raw, 127)]
    high = np.flatnonzero(raw >= 0xC0)
    if len(high):
        padded = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
        lead = padded[high]
        width = 2 + (lead >= 0xE0).astype(int) + (lead >= 0xF0)
        for w, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            at = high[width == w]
            cp = padded[at] & mask
            for i in range(1, w):
                cp = (cp << 6) | (padded[at + i] & 0x3F)
            kind = table[np.minimum(cp, sys.maxunicode)]
            for i in range(w):
                cls[at + i] = kind
    return cls


def pretokens(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of pre-tokens of consecutive texts that fill ``raw``: contractions;
    runs of letters, of digits and of other signs, each with one space before
    it; white space. Returns pre-token starts (ascending) and, for each text,
    the index of its first one (with one more at the end)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(starts) + 1, np.int64)
    cls = _byte_classes(raw)
    change = np.ones(n + 1, bool)
    change[1:n] = cls[1:] != cls[:-1]
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = True
    first[n] = True
    change |= first
    run = np.flatnonzero(change)
    run_s, run_e = run[:-1], run[1:]
    kind = cls[run_s]
    begin = np.zeros(n + 1, bool)
    begin[run_s] = True

    # A white run before other text gives up its last character.
    inner = (kind == _SPACE) & ~first[run_e]
    last = run_e[inner] - 1
    for _ in range(3):
        last = last - ((raw[last] & 0xC0) == 0x80)
    begin[last] = True
    joined = last[raw[last] == 0x20] + 1
    begin[joined] = False  # the space opens what follows it

    # An apostrophe that opens a match and stands before letters.
    quote = run_s[(kind == _OTHER) & (raw[run_s] == 0x27) & (run_e - run_s == 1)]
    quote = quote[begin[quote]]
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1] & (cls[quote + 1] == _LETTER)]
    if len(quote):
        padded = np.concatenate([raw, np.zeros(3, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        inside = ~first[np.minimum(quote + 2, n)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = inside & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for hit, width in ((one, 2), (two & ~one, 3)):
            at = quote[hit]
            begin[at + 1] = False
            after = at + width
            same = (after < n) & ~first[np.minimum(after, n)]
            begin[after[same]] = True
    begin[n] = False
    at = np.flatnonzero(begin)
    return at, np.concatenate([np.searchsorted(at, starts), [len(at)]])
