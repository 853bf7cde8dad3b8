"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Letters, digits and everything beyond ASCII, on UTF-8 bytes of lower-cased text.
_ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def blank_words(text: str | None) -> list[bytes]:
    """Words between blanks, tabs, line ends; A-Z lower-cased, nothing else changed."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters and digits; A-Z lower-cased, ASCII punctuation dropped."""
    return _ALNUM.findall(text.encode("utf-8", "replace").lower()) if text else []


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + _STEP) ^ hashes[i : i + n]
        out *= _M1
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles in ascending order; fewer than ``k`` words are one shingle, no words none."""
    if 0 < len(hashes) < k:
        return rolled(hashes, len(hashes))
    return np.unique(rolled(hashes, k))
