"""Operator 12: language-model scores from an Elias-Fano n-gram trie.

Texts are cut into words at white space (A-Z lower-cased), and each ends in an end token. The model interpolates:
``P1 = (c(w) + 1) / (N + V + 1)`` and, for longer contexts ``h`` seen in training,
``P(w | h) = (c(hw) + mu * P(w | shorter h)) / (c(h) + mu)``; a context never seen leaves the shorter one's. Each sums to 1.

How it runs: documents are packed into blocks (rows of about ``BLOCK_BYTES`` of text: distinct words, and places as numbers of
these), and written once. For each order, a block sends each shard its distinct n-grams there, with training counts, the
context's count and the quantised lower-order probability (order 1: the words). A shard is one group of bounded size: it adds up the
blocks' counts, smooths and quantises, lays the level down as a memory-mapped Elias-Fano trie level (:mod:`eliasfano`), and
answers the blocks by successor search relative to the context: a code for each n-gram, or none. Blocks are stored anew with their answers
and the tables before that go. An n-gram that one block alone has is
answered by a mark: the block knows its count. So it does for all n-grams that hold such a one, which aren't sent. Blocks join their answers and go on to the
next order; with the last order's messages goes a sum per document, and places that wait for an answer are added to it. Word and node numbers are ``place * shards + shard``.

Scale: n-grams are distinct per block before they are shuffled, so a frequent one is a row's entry a block. The shard of an n-gram is that of its context, and
a context of many occurrences is dealt over more shards by its words, as its count is sent along. Shards grow in number
with the tokens; the driver learns N, V and the number of tokens only. Nothing is pruned, capped or sampled.

Defined results: null counts as the empty text, which is one end token; a text of any length is scored whole, as a block of its own if
it is long; repeated rows each have a row and, in training, each count; a null doc_id counts as the empty text in the split; other
columns are not looked at; an empty table gives no rows, and without training texts P1 is 1 for any token (score 0) and base_score is 0.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common
from cohortlens.llm.eliasfano import NONE, STEPS, Level, quantised

ORDER = 3
#: Chosen at order 2: the weight of the lower order in a context, in occurrences; of 64, 512 and 4096 the one that gave rows of the learnable fold 3 of 7
#: of sf0.1 the highest probability, learnt from the other learnable folds.
MU = 512.0
BLOCK_BYTES = 4 << 20
#: In place of a number and of a code: no other block holds the n-gram, so the block that does knows all of it.
OWN, OWN_CODE = -2, NONE - 1
#: Tokens a shard answers for, on average, and occurrences of a context for which it gets one more shard.
SHARD_TOKENS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SENT = "shard long, block long, gram binary"
_ANSWER = "block long, shard long, types long, tokens long, answer binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one block, bytes of like place side by side, compressed."""
    import zstandard

    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        if x.dtype == np.int64 and len(x) and x.min() >= 0 and x.max() < 1 << 32:
            x = x.astype(np.uint32)
        parts.append(struct.pack("<2sxxI", x.dtype.str[1:].encode(), len(x)) + x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(3).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, found = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sxxI", raw, at)
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 8).reshape(kind.itemsize, n)
        found.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 8 + n * kind.itemsize
    return found


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts by first appearance, a line each; places as numbers of these; and places of each text. The end token, the empty word, is 0."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = found.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    # White space at either end leaves empty words, which are none.
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    there = code != blank
    sizes = np.bincount(np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())[there], minlength=len(found)) + 1
    seq = np.zeros(sizes.sum(), np.uint32)
    inner = np.ones(len(seq), bool)
    inner[np.cumsum(sizes) - 1] = False
    seq[inner] = (code + 1 - ((code > blank) & (blank >= 0)))[there]
    words = pa.concat_arrays([pa.array([""], words.type), words.filter(pc.not_equal(words, ""))])
    (lines,) = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")
    return np.frombuffer(lines.as_buffer(), np.uint8), seq, sizes.astype(np.uint32)


def _lines(words: np.ndarray) -> pa.Array:
    """The words of ``_numbered``, one by one."""
    ends = np.append(np.flatnonzero(words == 10), len(words))
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends - np.arange(len(ends)))), pa.py_buffer(words[words != 10])])


def blocks(docs: DataFrame, learn: Column) -> tuple[DataFrame, str]:
    """Documents packed into blocks, and the type of their ids; ``learn`` says from which the model may learn."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), (F.monotonically_increasing_id()).alias("row"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in common.spans(pc.binary_length(texts).to_pylist(), BLOCK_BYTES):
                words, seq, sizes = _numbered(texts.slice(a, b - a))
                held = batch.column("learn").slice(a, b - a).to_numpy(False).astype(np.uint8)
                packed = [_pack(words), _pack(seq), _pack(sizes), _pack(held)]
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("doc_id").slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("row")[a].as_py()], pa.int64()), ids, *(pa.array([p], pa.binary()) for p in packed)], ["block", "doc_ids", "words", "seq", "sizes", "held"])

    found = kept.mapInArrow(rows, f"block long, doc_ids array<{kind}>, words binary, seq binary, sizes binary, held binary")
    return common.stored(found, "lm-blocks", "uncompressed", tidy=True), kind


def _word_shards(words: list[bytes], shards: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(shards)


class _Block:
    """A block with the answers so far: per place the node of the n-gram that ends there, its count, and the probability."""

    def __init__(self, row: dict, shards: int, total: int, types: int, mu: float = MU):
        self.block, self.shards = row["block"], shards
        (self.seq,), (self.sizes,), (self.held,) = (_unpack(row[c]) for c in ("seq", "sizes", "held"))
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.depth = np.arange(len(self.seq)) - np.repeat(starts, self.sizes)
        self.learnt = np.repeat(self.held, self.sizes).astype(bool)
        self.total, self.types, self.mu, self.order = total, types, mu, 0
        if "numbers" in row:
            number, self.count = (x.astype(np.int64) for x in _unpack(row["numbers"]))
            self.number = number + OWN
            self.begin()
        else:
            self.words = _unpack(row["words"])[0].tobytes().split(b"\n")

    def own_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of words in which they are sent, with shards and training counts."""
        shard = _word_shards(self.words, self.shards)
        order = np.argsort(shard, kind="stable")
        return order, shard[order], np.bincount(self.seq[self.learnt], minlength=len(self.words))[order]

    def learn_words(self, answers: list[bytes]) -> None:
        order, _, times = self.own_words()
        number, count = (np.concatenate(x).astype(np.int64) for x in zip(*map(_unpack, answers)))
        self.number, self.count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.number[order] = number = number + OWN
        self.count[order] = np.where(number == OWN, times, count)
        self.begin()

    def numbers(self) -> bytes:
        """What a block needs of its words once they are learnt."""
        return _pack(self.number - OWN, self.count)

    def begin(self) -> None:
        self.c = self.count[self.seq]
        self.p = (self.c + 1.0) / (self.total + self.types + 1)
        self.node, self.node_count, self.unit, self.order = self.number[self.seq], self.c, self.seq.astype(np.int64), 1

    def grams(self) -> None:
        """The distinct n-grams of the next order whose parts were seen in training, each with its code as if no other block held it; those to be sent have no part that is this block's own."""
        k = self.order + 1
        self.context_count = np.zeros(len(self.seq), np.int64)
        self.context_count[1:] = np.where(self.depth[1:] >= k - 1, self.node_count[:-1], 0)
        self.lower = np.where(self.context_count > 0, self.mu * self.p / (self.context_count + self.mu), self.p)
        self.places = np.flatnonzero((self.context_count > 0) & (self.node_count > 0))
        first, self.inverse, _ = _groups(self.unit[self.places - 1] * len(self.number) + self.seq[self.places])
        self.at = self.places[first]
        self.times = np.bincount(self.inverse[self.learnt[self.places]], minlength=len(first))
        self.lower_codes = np.minimum(np.rint(-np.log10(self.p[self.at]) * STEPS), NONE - 1).astype(np.uint16)
        self.codes = _own_codes(self.times, self.lower_codes, self.context_count[self.at], self.mu)
        sent = np.flatnonzero((self.node[self.at - 1] >= 0) & (self.node[self.at] >= 0))
        h, w = self.node[self.at[sent] - 1], self.number[self.seq[self.at[sent]]]
        sent = sent[order := np.argsort(_joint(h, w))]
        h, w = h[order], w[order]
        salts = 1 + self.context_count[self.at[sent]] // SHARD_TOKENS
        shard = (((h + (w % salts) * 1_000_003).astype(np.uint64) * _MIX >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard.astype(np.uint16) if self.shards <= 1 << 16 else shard, kind="stable")
        self.sent, self.shard, self.h, self.w = sent[order], shard[order], h[order], w[order]

    def messages(self) -> Iterator[tuple[int, int, bytes]]:
        """The n-grams for each shard, contexts by their distance from the one before."""
        held, starts = np.unique(self.shard, return_index=True)
        for s, a, b in zip(held.tolist(), starts, [*starts[1:], len(self.shard)]):
            own = self.sent[a:b]
            yield s, self.block, _pack(np.diff(self.h[a:b], prepend=0), self.w[a:b], self.context_count[self.at[own]], self.times[own], self.lower_codes[own])

    def learn(self, answers: list[bytes]) -> None:
        self.grams()
        node, count = np.where(self.times > 0, OWN, -1), self.times.astype(np.int64)
        if len(self.sent):
            code, number, n = (np.concatenate(x) for x in zip(*map(_unpack, answers)))
            told = self.sent[code != OWN_CODE]
            self.codes[told] = code[code != OWN_CODE]
            node[told], count[told] = -1, 0
            there = self.sent[code < OWN_CODE]
            node[there], count[there] = number, n
        self.p, codes = self.lower, self.codes[self.inverse]
        there = codes != NONE
        self.p[self.places[there]] = 10.0 ** (-codes[there].astype(float) / STEPS)
        self.node, self.node_count, self.unit = (np.full(len(self.seq), v, np.int64) for v in (-1, 0, -1))
        self.node[self.places], self.node_count[self.places], self.unit[self.places] = node[self.inverse], count[self.inverse], self.inverse
        self.order += 1

    def rest(self, order: int) -> bytes:
        """Sums per document without the places whose n-grams are sent, and for these, by n-gram, the documents, their number, and of what both values are made.

        From order 3 on the lower order's value is a code, as what is sent was answered; at order 2 it is given as it is.
        """
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        add = lambda x: np.add.reduceat(x, starts)
        base = np.log10((self.c + 1.0) / (self.total + self.types + 1)) if self.total else np.zeros(len(self.c))
        waiting = [np.empty(0, kind) for kind in (np.uint32, np.uint32, np.uint16, np.int64, np.int64, float)]
        if order == 1:
            log = np.log10(self.p)
        else:
            log, codes = np.log10(self.lower), self.codes[self.inverse]
            there = codes != NONE
            log[self.places[there]] = codes[there] / -STEPS
            number = np.full(len(self.codes), -1, np.int64)
            number[self.sent] = np.arange(len(self.sent))
            gram = number[self.inverse]
            at, gram = self.places[gram >= 0], gram[gram >= 0]
            # By n-gram, so that a number of places each takes less room than the n-gram of each place.
            waiting = [np.repeat(np.arange(len(self.sizes)), self.sizes)[at[np.argsort(gram)]].astype(np.uint32), np.bincount(gram, minlength=len(self.sent)).astype(np.uint32), self.lower_codes[self.sent], self.context_count[own := self.at[self.sent]], self.times[self.sent], np.log10(self.lower[own]) if order == 2 else np.empty(0)]
            log[at] = 0.0
        return _pack(self.held, self.sizes, add((self.c > 0).astype(np.int64)), add(base), add(log), *waiting)


def _scores(rest: bytes, answers: list[bytes], mu: float = MU) -> list[np.ndarray]:
    """learnt, n_tokens, n_known, base_score and score of a block's documents."""
    held, sizes, known, base, score, doc, places, lower_codes, context_count, times, lower = _unpack(rest)
    if len(doc):
        code = np.concatenate([_unpack(a)[0] for a in answers])
        code = np.where(code == OWN_CODE, _own_codes(times, lower_codes, context_count, mu), code)
        if not len(lower):
            lower = np.log10(mu * 10.0 ** (-lower_codes.astype(float) / STEPS) / (context_count + mu))
        score = score + np.bincount(doc, np.repeat(np.where(code == NONE, lower, code / -STEPS), places), len(score))
    return [held.astype(bool), sizes.astype(np.int64), known.astype(np.int64), base, score]


def _joint(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A number for each n-gram that orders by context and word."""
    bits = int(w.max(initial=0)).bit_length()
    if int(h.max(initial=0)).bit_length() + bits > 63:
        h = np.unique(h, return_inverse=True)[1]
    return h << bits | w


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct key, which rise, the place of one; for each key its number among these; and the sizes."""
    order = np.argsort(key)
    held = key[order]
    new = np.append(True, held[1:] != held[:-1])[:len(key)]
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return order[starts], inverse, np.diff(np.append(starts, len(key)))


def _smoothed(count: np.ndarray, lower_codes: np.ndarray, context_count: np.ndarray, mu: float) -> np.ndarray:
    return (count + mu * 10.0 ** (-lower_codes.astype(float) / STEPS)) / (context_count + mu)


def _own_codes(times: np.ndarray, lower_codes: np.ndarray, context_count: np.ndarray, mu: float) -> np.ndarray:
    """Codes of n-grams as if no other block held them."""
    return np.where(times > 0, np.minimum(quantised(_smoothed(times, lower_codes, context_count, mu)), OWN_CODE - 1), NONE).astype(np.uint16)


def _word_shard(table: pa.Table, shards: int) -> pa.Table:
    """Numbers and counts of a shard's words, for each block in the order in which it sent them."""
    sent = [_unpack(m.as_py()) for m in table.column("gram")]
    shard = table.column("shard")[0].as_py()
    sizes = [len(times) for _, times in sent]
    coded = pa.concat_arrays([_lines(words) for words, _ in sent]).dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary
    counts = np.bincount(code, np.concatenate([times for _, times in sent]), len(words)).astype(np.int64)
    # A word of one block is its own; those of many occurrences have small numbers, which take less room.
    held = np.flatnonzero((np.bincount(code, minlength=len(words)) > 1) & (counts > 0))
    order = pc.sort_indices(pa.table({"n": counts[held], "word": words.take(pa.array(held))}), sort_keys=[("n", "descending"), ("word", "ascending")])
    number, told = np.where(counts > 0, 0, -1 - OWN), np.zeros(len(words), np.int64)
    number[held[order.to_numpy()]] = np.arange(len(held)) * shards + shard - OWN
    told[held] = counts[held]
    stops = np.cumsum(sizes)
    answers = [_pack(number[code[b - n:b]], told[code[b - n:b]]) for n, b in zip(sizes, stops)]
    blank = [None] * len(answers)
    return _answers([*table.column("block").to_pylist(), None], [shard] * (len(answers) + 1), [*blank, int((counts > 0).sum())], [*blank, int(counts.sum())], [*answers, None])


def _answers(block: list, shard: list, types: list, tokens: list, answer: list) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int64()), "shard": pa.array(shard, pa.int64()), "types": pa.array(types, pa.int64()), "tokens": pa.array(tokens, pa.int64()), "answer": pa.array(answer, pa.binary())})


def _gram_shard(table: pa.Table, shards: int, nodes: bool, mu: float) -> pa.Table:
    """The level of one shard, built from the n-grams that several blocks sent, and its answers to each block."""
    sent = [_unpack(m.as_py()) for m in table.column("gram")]
    sizes = [len(x[0]) for x in sent]
    h, w, context_count, times, codes = (np.concatenate(x) for x in zip(*([np.cumsum(x[0], dtype=np.int64), *x[1:]] for x in sent)))
    w = w.astype(np.int64)
    first, inverse, n_blocks = _groups(_joint(h, w))
    counts = np.bincount(inverse, times, len(first)).astype(np.int64)
    shared = (n_blocks > 1)[inverse]
    kept = (n_blocks > 1) & (counts > 0)
    first, counts = first[kept], counts[kept]
    shard = table.column("shard")[0].as_py()
    answers, stop = [], 0
    with Level.file(h[first], w[first], _smoothed(counts, codes[first], context_count[first], mu), counts) as file:
        level = Level(file)
        for n in sizes:
            start, stop = stop, stop + n
            asked = np.flatnonzero(shared[start:stop]) + start
            at = level.find(h[asked], w[asked])
            there, at = asked[at >= 0], at[at >= 0]
            answer = np.where(shared[start:stop], NONE, OWN_CODE).astype(np.uint16)
            answer[there - start] = np.minimum(level.codes[at], OWN_CODE - 1)
            answers.append(_pack(answer, at * shards + shard, level.counts(at)) if nodes else _pack(answer))
    blank = [None] * len(answers)
    return _answers(table.column("block").to_pylist(), [shard] * len(answers), blank, blank, answers)


def score(docs: DataFrame, learn: Column, order: int = ORDER, mu: float = MU) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score and score of each text, by a model of the texts with ``learn``."""
    state, kind = blocks(docs, learn)
    tokens = state.select(F.sum(F.octet_length("seq"))).first()[0] or 0
    # Places take about two bytes each in their compressed form.
    shards = max(1, -(-tokens // (2 * SHARD_TOKENS)))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, shards, 0, 0)
                where, shard, times = block.own_words()
                held, starts = np.unique(shard, return_index=True)
                for s, a, b in zip(held.tolist(), starts, [*starts[1:], len(shard)]):
                    text = np.frombuffer(b"\n".join(block.words[i] for i in where[a:b]), np.uint8)
                    yield pa.RecordBatch.from_pylist([{"shard": s, "block": row["block"], "gram": _pack(text, times[a:b].astype(np.uint32))}], sent_schema)

    sent_schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("gram", pa.binary())])
    words = state.mapInArrow(send_words, _SENT).groupBy("shard").applyInArrow(lambda table: _word_shard(table, shards), _ANSWER)
    words = common.stored(words, "lm-words", "uncompressed", tidy=True)
    totals = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    total, types = int(totals[0]), int(totals[1])

    def joined(state: DataFrame, level: DataFrame, name: str) -> DataFrame:
        """Each block with its answers, in the order of their shards."""
        own = level.where("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "answer"))).alias(name))
        return state.join(own, "block", "left").select(*state.columns, F.col(f"{name}.answer").alias(name))

    def block_of(row: dict, levels: int) -> _Block:
        block = _Block(row, shards, total, types, mu)
        for k in range(2, levels + 1):
            block.learn(row[f"answers_{k}"] or [])
        return block

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.drop_columns(["doc_ids"]).to_pylist()[0]
                block = _Block(row, shards, total, types, mu)
                block.learn_words(row["answers"])
                yield pa.RecordBatch.from_arrays([*map(one.column, ("block", "doc_ids", "seq", "sizes", "held")), pa.array([block.numbers()], pa.binary())], ["block", "doc_ids", "seq", "sizes", "held", "numbers"])

    def moved(new: DataFrame, *old: DataFrame) -> DataFrame:
        """Blocks with what they learnt are stored in place of the former tables, so that later steps need no shuffle of them."""
        new = common.stored(new, "lm-blocks", "uncompressed", tidy=True)
        common.removed(*old)
        return new

    state = moved(joined(state, words, "answers").mapInArrow(learnt, f"block long, doc_ids array<{kind}>, seq binary, sizes binary, held binary, numbers binary"), state, words)
    answered = lambda nodes: lambda table: _gram_shard(table, shards, nodes, mu)
    for k in range(2, order):

        def send(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = block_of(batch.slice(i, 1).drop_columns(["doc_ids"]).to_pylist()[0], k - 1)
                    block.grams()
                    for s, of, gram in block.messages():
                        yield pa.RecordBatch.from_pylist([{"shard": s, "block": of, "gram": gram}], sent_schema)

        grams = common.stored(state.mapInArrow(send, _SENT).groupBy("shard").applyInArrow(answered(True), _ANSWER), f"lm-grams-{k}", "uncompressed", tidy=True)
        state = moved(joined(state, grams, f"answers_{k}"), state, grams)

    def send_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The messages of the last order, and a row without a shard for what is left of the block."""
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = one.column("doc_ids")
                row = lambda s, of, data, ids: pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([of], pa.int64()), pa.array([data], pa.binary()), ids], ["shard", "block", "gram", "doc_ids"])
                block = block_of(one.drop_columns(["doc_ids"]).to_pylist()[0], order - 1)
                if order > 1:
                    block.grams()
                    for message in block.messages():
                        yield row(*message, pa.nulls(1, ids.type))
                yield row(None, block.block, block.rest(order), ids)

    last = common.stored(state.mapInArrow(send_last, f"{_SENT}, doc_ids array<{kind}>"), "lm-last", "uncompressed", tidy=True)
    common.removed(state)
    answers = last.where("shard is not null").select("shard", "block", "gram").groupBy("shard").applyInArrow(answered(False), _ANSWER)
    answers = common.stored(answers, "lm-answers", "uncompressed", tidy=True)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found = _scores(one.column("gram")[0].as_py(), one.column("answers")[0].as_py() or [], mu)
                yield pa.RecordBatch.from_arrays(
                    [one.column("doc_ids").flatten(), *map(pa.array, found), pa.array(np.full(len(found[0]), total))],
                    ["doc_id", "learnt", "n_tokens", "n_known", "base_score", "score", "train_tokens"],
                )

    rest = joined(last.where("shard is null").select("block", "gram", "doc_ids"), answers, "answers")
    return rest.mapInArrow(sums, f"doc_id {kind}, learnt boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long")
