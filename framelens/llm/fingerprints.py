"""Snippets of texts (all substrings of 16 letters and digits) as 64-bit hashes, computed on whole arrays."""

from __future__ import annotations

import re

import numpy as np

WIDTH = 16
#: Articles with less content than this take no part in the comparisons of near copies.
LEAST_CONTENT = 300
_JUNK = re.compile(r"[\W_]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS = [_U(pow(_BASE, 2**i, 2**64)) for i in range(4)]


def normalised(title: str | None, content: str | None) -> str:
    """Title, a blank and content in lower case, without all but letters and digits. Null counts as empty."""
    return _JUNK.sub("", f"{title or ''} {content or ''}".lower())


def mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def snippet_hashes(text: str) -> np.ndarray:
    """One hash for each window of 16 characters, in order, repeats included; none if the text is shorter."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
    if len(a) < WIDTH:
        return a[:0]
    a = (a + _U(1)) * _U(0xD6E8FEB86659FD93)
    a ^= a >> _U(32)
    for i, power in enumerate(_POWERS):
        step = 2**i
        a = a[:-step] * power + a[step:]
    return mix(a)


def snippet_set(text: str) -> np.ndarray:
    return np.unique(snippet_hashes(text))


def bottom_k(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest different hashes, ascending; all of them if there are fewer."""
    n = 2 * k
    while n < len(hashes):
        low = np.unique(np.partition(hashes, n - 1)[:n])
        if len(low) >= k:
            return low[:k]
        n *= 4
    return np.unique(hashes)[:k]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
