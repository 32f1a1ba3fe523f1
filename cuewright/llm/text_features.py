"""Features of whole texts in numpy: shape of the writing, and the set of words it uses."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
_LINE = re.compile(r"[^\n]+")
N_SHAPE = 128 + 8
_known: dict[str, int] = {}


def shape(text: str) -> np.ndarray:
    """``N_SHAPE`` numbers that do not grow with the text: square roots of the rates of ASCII
    characters, then length, word length, share of distinct words, repeated words next to each
    other, repeated word pairs, the most frequent word, repeated lines and words without a vowel or
    lower case. The empty text gives zeros.
    """
    out = np.zeros(N_SHAPE)
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=128)
    out[:128] = np.sqrt(counts[:128] / len(data))
    words = text.split()
    n = len(words)
    if n:
        seen = Counter(words)
        lines = [x for x in _LINE.findall(text) if not x.isspace()]
        out[128:] = [
            np.log1p(n) / 10.0,
            np.log1p(len(data) / n),
            len(seen) / n,
            np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n),
            np.sqrt(1.0 - len(set(zip(words, words[1:]))) / (n - 1)) if n > 1 else 0.0,
            np.sqrt(max(seen.values()) / n),
            np.sqrt(1.0 - len(set(lines)) / max(len(lines), 1)),
            np.sqrt(sum(c for w, c in seen.items() if w.isupper()) / n),
        ]
    return out


def word_set(text: str, width: int) -> np.ndarray:
    """Sorted buckets below ``width`` of the distinct lower-case letter words and word beginnings.

    Beginnings of four and five letters stand for the forms of one stem.
    """
    if len(_known) > 1_000_000:
        _known.clear()
    found = set(WORD.findall(text.lower()))
    found |= {w[:n] + "*" for n in (4, 5) for w in found if len(w) > n}
    buckets = set()
    for word in found:
        code = _known.get(word)
        if code is None:
            code = _known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        buckets.add(code % width)
    return np.array(sorted(buckets), np.int32)
