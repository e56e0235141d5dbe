"""Hashed character n-grams of words, and sums of per-word weights over texts."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import regex

#: Runs of letters of any script; ``re`` also takes numbers such as U+00B2 for letters.
LETTERS, PURE = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
CACHE_WORDS = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    words = LETTERS.findall(text.lower()) if text else []
    return words if not words or text.isascii() or all(map(str.isalpha, words)) else [x for w in words for x in PURE.findall(w)]


def grams(words: list[str], low: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word, bucket)`` of every n-gram of ``low`` to ``high`` characters; a word has a space on either side."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, buckets, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, high + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * _FACTOR + codes[n - 1:]
        if n < low:
            continue
        inside = owner[:m] == owner[n - 1:]
        if n == 1:
            inside &= codes != 32
        x = h[inside] + np.uint64(n)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[:m][inside])
        buckets.append(((x ^ (x >> np.uint64(32))) * _FACTOR >> np.uint64(64 - bits)).astype(np.int64))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


class WordSums:
    """Sums over a text's words of the weights of their n-grams; each distinct word is looked at once."""

    def __init__(self, weights: np.ndarray, low: int, high: int, bits: int):
        self.weights, self.shape = weights, (low, high, bits)
        self.known: dict[str, int] = {}
        self.table = np.empty((0, weights.shape[1] + 1))

    def _add(self, words: list[str]) -> None:
        owner, bucket = grams(words, *self.shape)
        columns = [np.bincount(owner, self.weights[bucket, k], len(words)) for k in range(self.weights.shape[1])]
        new = np.stack([*columns, np.bincount(owner, minlength=len(words))], 1)
        self.known.update(zip(words, range(len(self.table), len(self.table) + len(words))))
        self.table = np.concatenate([self.table, new])

    def sums(self, texts: list) -> np.ndarray:
        """Per text (its words) the sums of weights, and last the number of n-grams."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.table = self.table[:0]
            new = set().union(*texts)
        if new:
            self._add(sorted(new))
        sizes = [len(t) for t in texts]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        text = np.repeat(np.arange(len(texts)), sizes)
        return np.stack([np.bincount(text, self.table[at, k], len(texts)) for k in range(self.table.shape[1])], 1)
