"""Operator 5: mixture-controlled packing by deficit round-robin.

Each source is a queue of ids, its documents one behind the other. A round serves from each queue its quantum, which
is the queue's target share of one window; documents are cut where a quantum ends, so each window, and not only the
mean of many, is filled to the shares while no queue has run out. A queue whose quantum is under ``LEAST`` ids is
served ``LEAST`` at a time, in every so many rounds, at an offset within this period that is hashed from its name. This
has a closed form: slice ``c`` of a queue goes out in round ``floor((c + offset) * slice / quantum)``. So the whole
schedule, over all windows and partitions, is the order by (round, source, place in the queue), and the place of a
piece in the packed stream is a prefix sum over that order. Windows of ``window`` ids are cut from the stream.

Prefix sums run in levels (piece in a block of rounds, block in a group of blocks, group), so no task and no
driver holds more than a bounded group: a piece has an id at least, so a block has no more rows than ids. Only lengths take part; the ids move once, in one shuffle,
compressed by document, and are cut behind it.

Defined results: null text counts as empty (a document of the end id alone); null or empty source is a queue of
its own; a source whose target share is 0 or less is packed behind all others; repeated rows are packed each; an empty table gives no row; columns besides doc_id, text and source are
not looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm import common

WINDOW = 2048
END_ID = 1
#: Rounds in a block and blocks in a group: a block is about ROUNDS windows of ids.
ROUNDS, BLOCKS = 64, 4096
#: The fewest ids that a queue is served at a time.
LEAST = 32
#: The first round of sources without a share.
LAST = 1 << 40
#: ASCII marks that the tokenizer always splits from a letter before them.
MARKS = ".,;:!?"
_MARKS = re.compile(rb"(?<=[a-zA-Z])([.,;:!?]+)(?=\s|\Z)")
#: Words kept in a Python worker: a half that is filled, and the half before that.
CACHE_WORDS = 240_000


class WordIds:
    """Ids of white-space separated UTF-8 words, kept as little-endian bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words. Marks behind
    a word are cut off, as the tokenizer itself does, and A-Z become a-z before that, so that fewer words are new.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.others = tokenizer = Tokenizer.from_file(path)
        self.letters, self.ascii = Tokenizer(tokenizer.model), Tokenizer(tokenizer.model)
        # Words of letters alone need no patterns, and those of a-z are in the normal form.
        self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii.normalizer = normalizers.Sequence([])
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.width = 2 if max(len(self.ends_word) - 1, END_ID) < 1 << 16 else 4
        self.end = END_ID.to_bytes(self.width, "little")
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encoded(self, texts: list[str], tokenizer) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add_words(self, words: list[bytes], tokenizer) -> None:
        """Words of letters alone: many in one text, cut again behind the pieces that end a word."""
        for at in range(0, len(words), 512):
            some = words[at:at + 512]
            (ids,) = self.encoded([b" ".join(some).decode()], tokenizer)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                data, ends = ids.tobytes(), (ends * self.width).tolist()
                self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends))))
            else:
                self.known.update(zip(some, (x.tobytes() for x in self.encoded([w.decode() for w in some], tokenizer))))

    def add(self, chunks: set[bytes]) -> None:
        words = [c for c in chunks if c.isalpha() and c.islower()]  # a-z
        cut, cores, others = [], set(), []
        for chunk in chunks.difference(words):
            text = chunk.decode()
            core = text.rstrip(MARKS)
            if core.isalpha() and core.lower().isalpha():
                mark = text[len(core):].encode()
                core = core.encode()
                cores.add(core)
                if mark:
                    cut.append((chunk, core, mark))
            else:
                others.append(chunk)
        others += {m for *_, m in cut}.difference(self.known, others)
        self.add_words(words, self.ascii)
        self.add_words(list(cores.difference(self.known)), self.letters)
        self.known.update(zip(others, (x.tobytes() for x in self.encoded([c.decode() for c in others], self.others))))
        self.known.update((c, self.known[w] + self.known[m]) for c, w, m in cut)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian unsigned numbers of ``width`` bytes."""
        # A letter and a combining mark (CC or CD in UTF-8) may compose only once they are in lower case.
        chunks = [_MARKS.sub(rb" \1", t if b"\xcc" in t or b"\xcd" in t else t.lower()).split() for t in texts]
        vocabulary = set().union(*chunks)
        new = vocabulary.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS // 2:
            self.before, self.known = self.known, {}
            new = vocabulary
        again = new & self.before.keys()
        self.known.update((w, self.before[w]) for w in again)
        if len(again) < len(new):
            self.add(new - again)
        return [b"".join(map(self.known.__getitem__, ws)) + self.end for ws in chunks]


def unpacked_ids(data: bytes, n: int, decompressor: zstandard.ZstdDecompressor) -> bytes:
    """``n`` compressed ids, of 32 bits each."""
    data = decompressor.decompress(data)
    return data if len(data) == 4 * n else np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row: doc_id, source, part and pos (its key here), n ids, ids (compressed), and ``before``: ids of its source before it in its part."""
    kept = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    doc_type = kept.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words = common.held(("packing", path), lambda: WordIds(path))
        part, pos, sent = TaskContext.get().partitionId(), 0, {}
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in common.slices(batches, "text", 4 << 20):
            ids = words.ids(batch.column("text").to_pylist())
            sources, before = batch.column("source").to_pylist(), []
            for s, x in zip(sources, ids):
                before.append(sent.get(s, 0))
                sent[s] = before[-1] + len(x) // words.width
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("source"), pa.array([part] * len(ids), pa.int32()),
                    pa.array(range(pos, pos + len(ids)), pa.int64()), pa.array([len(x) // words.width for x in ids], pa.int64()),
                    pa.array(before, pa.int64()), pa.array(map(compress, ids), pa.binary()),
                ],
                ["doc_id", "source", "part", "pos", "n", "before", "ids"],
            )
            pos += len(ids)

    return kept.mapInArrow(rows, f"doc_id {doc_type}, source string, part int, pos long, n long, before long, ids binary")


def placed(tokens: DataFrame, targets: Mapping[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """The pieces of each document (part, pos) in the packed stream: first id in the document, ids, place in the stream.

    ``targets`` gives token shares by source; sources it lacks, and all where it is None, take their share of
    the corpus.
    """
    total = tokens.agg(F.sum("n")).first()[0] or 0
    totals = tokens.groupBy("source", "part").agg(F.sum("n").alias("sent"))
    by_source = Window.partitionBy("source")
    share = F.sum("sent").over(by_source) / F.lit(float(max(total, 1)))
    if targets:
        wanted = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])
        share = F.coalesce(F.try_element_at(wanted, F.col("source")), share)
    queues = totals.select(
        "source", "part", (share * window).alias("quantum"), F.sum("sent").over(by_source).alias("total"),
        (F.sum("sent").over(by_source.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sent")).alias("base"),
    )
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0"))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    queues = queues.select(
        "source", "part", "quantum", "base", offset.alias("offset"),
        F.when(F.col("quantum") > 0, F.greatest("quantum", F.least(F.lit(LEAST), "total").cast("double"))).otherwise(F.lit(float(window))).alias("slice"),
    )
    t, q = tokens.select("source", "part", "pos", "n", "before").alias("t"), queues.alias("q")
    first = F.col("q.base") + F.col("t.before")
    found = t.join(q, F.col("t.source").eqNullSafe(F.col("q.source")) & (F.col("t.part") == F.col("q.part"))).select(
        "t.source", "t.part", "t.pos", first.alias("first"), (first + F.col("t.n")).alias("end"), "q.quantum", "q.slice", "q.offset",
    )
    # A slice on each side more, should a quotient be rounded; what is empty goes.
    found = found.withColumn("c", F.explode(F.sequence(F.greatest(F.floor(F.col("first") / F.col("slice")) - 1, F.lit(0)), F.floor(F.col("end") / F.col("slice")) + 1)))
    lo, hi = F.greatest("first", F.floor(F.col("c") * F.col("slice"))), F.least("end", F.floor((F.col("c") + 1) * F.col("slice")))
    turn = F.when(F.col("slice") > F.col("quantum"), F.col("c") + F.col("offset")) * F.col("slice") / F.col("quantum")
    round_ = F.when(F.col("quantum") > 0, F.coalesce(F.floor(turn), F.col("c"))).otherwise(F.col("c") + LAST)
    served = found.select("source", "part", "pos", (lo - F.col("first")).alias("start"), (hi - lo).alias("n"), lo.alias("queued"), round_.alias("round")).where("n > 0")
    served = served.withColumn("block", F.floor(F.col("round") / ROUNDS)).withColumn("rows", F.floor(F.col("block") / BLOCKS))
    blocks = served.groupBy("rows", "block").agg(F.sum("n").alias("sent"))
    groups = blocks.groupBy("rows").agg(F.sum("sent").alias("sent"))
    before = lambda w: F.sum("sent").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("sent")
    # One row for BLOCKS * ROUNDS windows, half a billion ids: few enough for one task at any size of input.
    groups = groups.select("rows", before(Window.orderBy("rows")).alias("group_base"))
    blocks = blocks.join(groups, "rows").select("block", (F.col("group_base") + before(Window.partitionBy("rows").orderBy("block"))).alias("block_base"))
    order = Window.partitionBy("block").orderBy("round", "source", "queued").rowsBetween(Window.unboundedPreceding, 0)
    within = served.select("part", "pos", "start", "n", "block", (F.sum("n").over(order) - F.col("n")).alias("within"))
    return within.join(blocks, "block").select("part", "pos", "start", "n", (F.col("block_base") + F.col("within")).alias("at"))


def tail(total: int, window: int = WINDOW) -> list[int]:
    """Starts of the sequences of the last, partial window: powers of two, so that none is padded."""
    rest, at, starts = total % window, total - total % window, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        starts.append(at)
        at, rest = at + size, rest - size
    return starts


def pack(docs: DataFrame, targets: Mapping[str, float] | None = None, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids; a row with its ids for each piece."""
    tokens = common.stored(tokenized(docs, tokenizer), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = placed(tokens, targets, window).groupBy("part", "pos").agg(F.sort_array(F.collect_list(F.struct("start", "n", "at"))).alias("parts"))
    found = tokens.drop("before").join(parts, ["part", "pos"]).select("doc_id", "source", "n", "ids", "parts")
    return cut(found, total, window)


def cut(tokens: DataFrame, total: int, window: int) -> DataFrame:
    """The pieces of documents whose ``parts`` stand ``at`` places in the stream of ``total`` ids, cut into sequences."""
    whole = total - total % window
    starts = np.array([*tail(total, window), total], np.int64)
    doc_type = tokens.schema["doc_id"].dataType.simpleString()

    def sequences(place: np.ndarray) -> np.ndarray:
        return np.where(place < whole, place // window, whole // window + np.searchsorted(starts, place, side="right") - 1)

    def first(sequence: np.ndarray) -> np.ndarray:
        behind = sequence - whole // window
        return np.where(behind < 0, sequence * window, starts[np.clip(behind, 0, len(starts) - 1)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        for batch in common.slices(batches, "ids", 1 << 20):
            n = batch.column("n").to_numpy()
            data = b"".join(unpacked_ids(z, k, decompressor) for z, k in zip(batch.column("ids").to_pylist(), n.tolist()))
            parts = batch.column("parts")
            size, at = (parts.flatten().field(c).to_numpy() for c in ("n", "at"))
            owner = np.repeat(np.arange(len(n)), parts.value_lengths().to_numpy())
            # Neighbours in the stream are one; each is cut where a sequence ends. A document's pieces lie one behind the other.
            new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + size[:-1])))
            owner, at, size = owner[new], at[new], np.add.reduceat(size, new)
            low = sequences(at)
            times = sequences(at + size - 1) - low + 1
            sequence = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            begin, end = first(sequence), first(sequence + 1)
            stop = np.minimum(end, np.repeat(at + size, times))
            place = np.maximum(begin, np.repeat(at, times))
            owner, length = np.repeat(owner, times), stop - place
            ends = np.cumsum(length)
            offsets = np.append(0, 4 * ends).astype(np.int32)
            numbers = (ends - length - (np.cumsum(n) - n)[owner], length, n[owner], sequence, place - begin)
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(owner), *map(pa.array, numbers), batch.column("source").take(owner),
                    pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"],
            )

    return tokens.mapInArrow(rows, f"doc_id {doc_type}, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
