"""Characters of many texts as one array, and tables over all code points."""

from __future__ import annotations

from functools import cache

import numpy as np

TOP = 0x110000


@cache
def letters_lowered() -> np.ndarray:
    """Of each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(TOP, 0x20, np.uint32)
    for block in range(0, TOP, 1 << 12):
        if 0xD000 <= block < 0xE000 or block >= 0x40000:  # surrogates hold no letters; nor do the planes above
            span = range(block, min(0xD800, block + (1 << 12))) if block == 0xD000 else range(0)
        else:
            span = range(block, block + (1 << 12))
        for i in span:
            c = chr(i)
            if c.isalpha():
                out[i] = ord(c.lower()[0])
    return out


@cache
def word_chars_lowered() -> np.ndarray:
    """As ``letters_lowered``, with digits and other word characters kept."""
    out = letters_lowered().copy()
    for i in range(0x40000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if out[i] == 0x20 and (c.isalnum() or c == "_"):
            out[i] = i
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: list[str], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All code points with ``gap`` spaces after each text, and where each text starts (one more entry at the end)."""
    sep = " " * gap
    lengths = np.fromiter((len(t) + gap for t in texts), np.int64, len(texts))
    return code_points(sep.join(texts) + sep * bool(texts)), np.concatenate([[0], np.cumsum(lengths)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def span_hashes(x: np.ndarray):
    """A function from (begins, ends) to 64-bit hashes of those spans of x, equal for equal spans.

    Prefix sums of x[i] * base**i modulo 2**64; an odd base has an inverse, which shifts a span to its beginning.
    """
    n = len(x) + 1
    if not _powers or len(_powers[0]) < n:
        both = [np.full(max(n, 1 << 20), b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for p in both:
            p[0] = 1
        _powers[:] = [np.cumprod(p, dtype=np.uint64) for p in both]
    up, down = _powers
    total = np.zeros(n, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=total[1:])
    return lambda a, b: mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
