"""Elias-Fano sequences, and a level of an n-gram trie made of them, in a memory-mapped file."""

from __future__ import annotations

import json
import tempfile

import numpy as np

#: Quantised probabilities: -log10(p) in steps of 1 / STEPS; NONE marks an n-gram that isn't there.
STEPS, NONE = 2048, 65535


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), NONE - 1).astype(np.uint16)


class EliasFano:
    """A nondecreasing sequence: the low bits of each value packed, the high bits in unary."""

    @staticmethod
    def arrays(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-bits // 8)], axis=1, bitorder="little")[:, :bits]
        high = np.zeros(n + (top >> bits) + 1, np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return {
            f"{name}.n": np.array([n, bits], np.int64), f"{name}.low": np.append(np.packbits(low.ravel(), bitorder="little"), np.zeros(8, np.uint8)),
            f"{name}.high": np.packbits(high, bitorder="little"),
        }

    def __init__(self, name: str, held: dict[str, np.ndarray]):
        self.n, self.bits = map(int, held[f"{name}.n"])
        low = held[f"{name}.low"]
        #: At each byte the eight from there on.
        self._low = np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))
        #: The directory of the unary part: the high bits of each value.
        self._high = np.flatnonzero(np.unpackbits(held[f"{name}.high"], bitorder="little"))[: self.n] - np.arange(self.n)

    def low(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.bits
        return (self._low[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self._high[at] << self.bits | self.low(at)

    def successor(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first place in ``[start, stop)`` whose value is ``x`` or more, else ``stop``: the values of equal high bits are searched by their low bits."""
        high = x >> self.bits
        a = np.clip(np.searchsorted(self._high, high, "left"), start, stop)
        b = np.clip(np.searchsorted(self._high, high, "right"), a, stop)
        want = x & ((1 << self.bits) - 1)
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self.low(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        return a

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it isn't there."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        at = self.successor(x, np.zeros(len(x), np.int64), np.full(len(x), self.n, np.int64))
        return np.where((at < self.n) & (self[np.minimum(at, self.n - 1)] == x), at, -1)


class Level:
    """The n-grams of one order in one shard: contexts, pointers to their successors, successors, probabilities and counts.

    A successor is kept as its rank among the shard's words, counted on from the last successor of the context before: the
    ranks of all contexts are one rising sequence, and a context's are searched between its pointers, relative to where it begins.
    """

    @staticmethod
    def file(contexts: np.ndarray, words: np.ndarray, p: np.ndarray, counts: np.ndarray):
        """An unlinked file of the level for sorted, distinct (context, word)."""
        held, starts = np.unique(contexts, return_index=True)
        vocabulary, rank = np.unique(words, return_inverse=True)
        stops = np.append(starts[1:], len(contexts))
        before = np.concatenate([[0], np.cumsum(rank[stops - 1] + 1)])[:-1] if len(held) else np.empty(0, np.int64)
        arrays = EliasFano.arrays("contexts", held) | EliasFano.arrays("pointers", np.append(starts, len(contexts))) | EliasFano.arrays("words", vocabulary)
        arrays |= EliasFano.arrays("children", np.repeat(before, stops - starts) + rank) | EliasFano.arrays("counts", np.cumsum(counts)) | {"codes": quantised(p)}
        head, at = {}, 0
        for name, x in arrays.items():
            head[name] = x.dtype.str, len(x), at
            at += -(-x.nbytes // 8) * 8
        text = json.dumps(head).encode()
        file = tempfile.TemporaryFile()
        file.write(len(text).to_bytes(8, "little") + text + b" " * (-len(text) % 8))
        for x in arrays.values():
            file.write(x.tobytes() + b"\0" * (-x.nbytes % 8))
        file.flush()
        return file

    def __init__(self, file):
        mapped = np.memmap(file, np.uint8, "r")
        size = int.from_bytes(mapped[:8].tobytes(), "little")
        base = 8 + -(-size // 8) * 8
        held = {k: mapped[base + at:base + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in json.loads(mapped[8:8 + size].tobytes()).items()}
        self.contexts, self.pointers, self.words, self.children, self._counts = (EliasFano(k, held) for k in ("contexts", "pointers", "words", "children", "counts"))
        self.codes, self.bytes = held["codes"], len(mapped)

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each n-gram, -1 where it isn't there."""
        context, rank = self.contexts.find(contexts), self.words.find(words)
        found = np.full(len(contexts), -1, np.int64)
        known = np.flatnonzero((context >= 0) & (rank >= 0))
        start, stop = self.pointers[context[known]], self.pointers[context[known] + 1]
        x = np.where(start > 0, self.children[np.maximum(start - 1, 0)] + 1, 0) + rank[known]
        at = self.children.successor(x, start, stop)
        there = at < stop
        there[there] = self.children[at[there]] == x[there]
        found[known[there]] = at[there]
        return found

    def counts(self, at: np.ndarray) -> np.ndarray:
        return self._counts[at] - np.where(at > 0, self._counts[np.maximum(at - 1, 0)], 0)
