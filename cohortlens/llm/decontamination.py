"""Operator 4: benchmark decontamination with an FM-index per training shard.

Spark's partitions are cut into shards of about ``SHARD_WORDS`` words. For each shard the words become symbols;
a suffix array (prefix doubling) gives the Burrows-Wheeler transform, which a wavelet matrix stores with its
ranks. All test phrases are searched backwards at once, one step of ranks for each of their words; occurrences
are located by walking to sampled suffix positions; their spans are merged within each document.

The phrases of a benchmark are sent to the executors in blocks of about ``BLOCK_BYTES`` of text, a pass for each,
so that what is broadcast is bounded whatever the benchmark's size. Nothing is shuffled.

Defined results: null text has no words and no hits; null or wordless items have no phrase; repeated items count
as one id each and repeated rows get a row each; items with a null id take part as the empty id; an empty table
gives no rows, an empty benchmark gives rows without hits. Columns besides doc_id, text and item_id are not
looked at, and kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

WINDOW = 13
SHARD_WORDS = 400_000
SAMPLE = 16
BLOCK_BYTES = 1 << 20
#: Bytes that are no part of a word become spaces; A-Z become a-z; bytes of other characters than ASCII stay.
_FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Sorted suffix positions by prefix doubling; ranks and positions are packed in one number to sort."""
    n = len(s)
    width = n.bit_length()
    bits = max(1, int(s.max()).bit_length())
    h = max(1, (63 - width) // bits) if bits + width <= 63 else 0
    if h:
        key = np.zeros(n, np.int64)
        for j in range(h):
            key <<= bits
            if j < n:
                key[:n - j] |= s[j:]
        packed = np.sort(key << width | np.arange(n))
        sa = packed & ((1 << width) - 1)
    else:
        h, key = 1, s
        sa = np.argsort(s, kind="stable")
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(key[sa[1:]], key[sa[:-1]], out=first[1:])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa
        at = sa[slots]
        after = at + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[at]
        if 3 * width + 1 <= 63:
            packed = np.sort((group << (width + 1) | second) << width | at)
            at, pair = packed & ((1 << width) - 1), packed >> width
        else:
            order = np.lexsort((second, group))
            at, pair = at[order], np.stack([group, second], 1)[order]
        sa[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1] if pair.ndim == 1 else (pair[1:] != pair[:-1]).any(axis=1)
        first[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2


class FMIndex:
    """Symbols from 1 up in an array that ends with the only 0."""

    def __init__(self, s: np.ndarray):
        n, sa = len(s), suffix_array(s)
        cur = s[sa - 1]
        counts = np.bincount(s)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.n, self.levels, self.ones, self.zeros = n, max(1, int(len(counts) - 1).bit_length()), [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])
        sampled = sa % SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = sa[sampled]

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo and before hi in the transform."""
        base = np.zeros(len(symbol), np.int64)
        for i in range(self.levels):
            bit = (symbol >> (self.levels - 1 - i) & 1).astype(bool)
            ones, zeros = self.ones[i], self.zeros[i]
            base, lo, hi = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (base, lo, hi))
        return lo - base, hi - base

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of the suffixes that begin with each phrase (a row of symbols)."""
        n = len(phrases)
        lo, hi, alive = np.zeros(n, np.int64), np.full(n, self.n, np.int64), np.arange(n)
        for step in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, step]
            a, b = self.ranks(c, lo[alive], hi[alive])
            lo[alive], hi[alive] = self.before[c] + a, self.before[c] + b
            alive = alive[b > a]
        hi[np.setdiff1d(np.arange(n), alive)] = 0
        return lo, np.maximum(hi, lo)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The text positions of rows: steps to the left until a sampled one."""
        at, todo, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        row = row.copy()
        while len(todo):
            r = row[todo]
            known = self.sampled[r + 1] > self.sampled[r]
            at[todo[known]] = self.samples[self.sampled[r[known]]] + steps
            todo, r = todo[~known], r[~known]
            symbol, base = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for i in range(self.levels):
                ones, zeros = self.ones[i], self.zeros[i]
                bit = ones[r + 1] > ones[r]
                symbol = symbol << 1 | bit
                base, r = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (base, r))
            row[todo] = self.before[symbol] + r - base
            steps += 1
        return at


def phrases_of(items: list[tuple[str, bytes]], window: int) -> dict[int, tuple[list[tuple[bytes, ...]], list[list[str]]]]:
    """By length: the distinct phrases and the ids of the items that hold each."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item_id, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            found[tuple(w[i:i + window])].add(item_id)
    by_length: dict[int, tuple[list, list]] = {}
    for p, ids in found.items():
        a, b = by_length.setdefault(len(p), ([], []))
        a.append(p)
        b.append(sorted(ids))
    return by_length


def _hits(docs: list[list[bytes]], phrases: dict) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged word spans and item ids of each document of a shard."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    vocabulary: dict[bytes, int] = {}
    number = vocabulary.setdefault
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = np.ones(int(sizes.sum()) + len(docs) + 1, np.int64)  # 1 ends a document
    s[-1] = 0
    for at, words in zip(starts.tolist(), docs):
        s[at:at + len(words)] = [number(w, len(vocabulary) + 2) for w in words]
    if not vocabulary:
        return spans, items
    index = FMIndex(s)
    ends = np.zeros(len(s) + 1, np.int64)  # one past the farthest end of the phrases that start here
    for length, (texts, ids) in phrases.items():
        known = [i for i, p in enumerate(texts) if all(w in vocabulary for w in p)]
        if not known:
            continue
        lo, hi = index.search(np.array([[vocabulary[w] for w in texts[i]] for i in known], np.int64))
        count = hi - lo
        phrase = np.repeat(np.arange(len(known)), count)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = index.locate(rows)
        np.maximum.at(ends, at, at + length)
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
            items[d].update(ids[known[p]])
    begun = np.flatnonzero(ends)
    if len(begun):
        reach = np.maximum.accumulate(ends[begun])
        new = np.ones(len(begun), bool)
        new[1:] = begun[1:] > reach[:-1]
        begin = begun[new]
        end = np.maximum.reduceat(ends[begun], np.flatnonzero(new))
        doc = np.searchsorted(starts, begin, side="right") - 1
        for d, a, b in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist()):
            spans[d].append((a, b))
    return spans, items


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks, of which one at a time is on the driver; an empty one where there are none."""
    kept = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")).where("t is not null")
    n = -(-(kept.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("i", "t"), F.lit(max(n, 1)))
    return ([tuple(r) for r in kept.where(block == b).collect()] for b in range(max(n, 1)))


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with n_words, item_ids (sorted) and spans: merged [start, stop) word places to remove."""
    spark = docs.sparkSession
    row = F.struct(*[common.col(docs, c) for c in docs.columns])
    out = docs.select(row.alias("row"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    schema, place = out.schema, docs.columns.index("text")
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(phrases_of(block, window))

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def shard() -> pa.RecordBatch:
                spans, items = _hits(words, sent.value)
                whole = pa.Table.from_batches(held).combine_chunks()
                old_items, old_spans = whole["item_ids"].to_pylist(), whole["spans"].to_pylist()
                return pa.RecordBatch.from_arrays(
                    [
                        whole["row"].chunk(0), pa.array(map(len, words), pa.int64()), pa.array([sorted({*a, *b}) for a, b in zip(old_items, items)], pa.list_(pa.string())),
                        pa.array([_merged([(x["start"], x["stop"]) for x in a] + b) for a, b in zip(old_spans, spans)], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    ],
                    ["row", "n_words", "item_ids", "spans"],
                )

            common.held("decontamination", dict)
            held, words, size = [], [], 0
            for batch in common.slices(batches, "row", 2 << 20):
                some = [words_of((t or "").encode()) for t in batch.column("row").field(place).to_pylist()]
                held.append(batch)
                words += some
                size += sum(map(len, some))
                if size >= SHARD_WORDS:
                    yield shard()
                    held, words, size = [], [], 0
            if held:
                yield shard()

        out = out.mapInArrow(rows, schema)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(b, out[-1]["stop"])
        else:
            out.append({"start": a, "stop": b})
    return out


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the words inside test phrases, the items and whether a twentieth of its words or more are hit."""
    found = removal_spans(docs.select("doc_id", "text"), benchmark).select("row.doc_id", "n_words", _n_hit().alias("n_hit"), "item_ids")
    items = F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), _contaminated().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, whole."""
    found = removal_spans(docs, benchmark).select("row", "n_words", _n_hit().alias("n_hit")).where(~_contaminated())
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
