"""Operator 8: token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character of a word; dynamic
programming carries, for each character, the best score and that path's number of pieces, no path itself. The rules
are those of the ``tokenizers`` Unigram model: candidates for a place in the order of their starts and only a
strictly higher score replaces (so the longer last piece wins a tie); a character without a piece of its own may be
unknown at the lowest score less 10, and unknown characters become their UTF-8 bytes.

The only public vocabulary with piece strings at hand is a byte-pair one, without unigram probabilities; a piece's
score here is ``-log(rank + 1)``, its place in that vocabulary under Zipf's law. The vocabulary's path is a parameter.
Control, unknown and byte pieces never match text.
Words are cut at white space and get the mark U+2581 in front; a word's count is kept, so each distinct word is
scored once in a worker.

Defined results: null and empty text have no tokens; repeated rows get a row each; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 250_000
#: Unicode's White_Space; Python's str.split() also cuts at U+001C to U+001F.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
_CONTROLS = re.compile("[\x1c-\x1f]")


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), -math.log(i + 1.0)) for i in range(model.get_piece_size()) if not special(i)]


class Counter:
    """Counts of words' pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(reversed(pieces)).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        """The number of pieces of a word with its mark."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        for i, matches in enumerate(ends):
            top, pieces, single = None, 0, False
            for length, score in sorted(matches, reverse=True):
                at = i + 1 - length
                single |= length == 1
                if top is None or best[at] + score > top:
                    top, pieces = best[at] + score, count[at] + 1
            if not single and (top is None or best[i] + self.unknown > top):
                top, pieces = best[i] + self.unknown, count[i] + len(word[i].encode("utf-8", "surrogatepass"))
            best[i + 1], count[i + 1] = top, pieces
        return count[n]

    def word(self, word: str) -> int:
        marked = word if word[0] == MARK else MARK + word
        return sum(map(self.pieces, re.findall(f"{MARK}[^{MARK}]*", marked, re.S)))

    def words(self, words: list[str]) -> int:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set(words)
        self.known.update((w, self.word(w)) for w in new)
        return sum(map(self.known.__getitem__, words))


def split(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _CONTROLS.search(text) else text.split()


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of each text."""
    kept = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = common.held(("token counts", model), lambda: Counter(vocabulary(model)))
        for batch in common.slices(batches, "text", 8 << 20):
            words = [split(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(map(counter.words, words), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return kept.mapInArrow(rows, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
