"""Operator 13: spelling variants grouped by pairless wildcard groups.

Two words are near if they differ by one replaced, inserted or deleted code point. No pair of words is ever formed:

* replacements: a word stands in one group for each of its positions, keyed by (position, prefix, suffix), the word
  with that code point left open. A group keeps its size and its first two words (largest n, then code-point order). A
  word has ``size - 1`` near words in it, of which the best is the first, or the second where it is the first itself. Two
  words of one length that differ in one place meet in that group alone, so sizes add up.
* insertions and deletions: the distinct deletions of a word are joined with the vocabulary. A match counts for both
  words; a word has at most as many as code points, so matches stay below the vocabulary's letters.

What groups and matches say is combined by word: counts are summed, the best is the least. A group's words differ in one
code point, so it has at most as many as the alphabet has letters (90), however large the vocabulary.
Roots follow forms by pointer jumping: n grows fivefold at each step, so few rounds are needed.

Every join here is asked for as a merge: Spark sizes a table by its compressed files and takes an explode to add no rows, so it
would broadcast all places of all words as long as the words' files are small.

Words are maximal runs of letters of the alphabet; A-Z alone are lower-cased. Runs that the rule below picks lose a
code point (planted misspellings that a caller can switch off). Each task counts a run of documents in memory of a
bounded number of words and emits sums, so a word that a third of all rows hold is a row a task.

Defined results: null and empty texts have no words; a text of any length is read whole; repeated rows count each time;
ties of n go to the smaller word by code points; a null doc_id counts as the empty text in the rule; other columns are
not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

#: The alphabet A-Z, a-z and U+00C0 to U+00FF as UTF-8, behind lower-casing.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
DROP_EVERY = 199
#: Words that a task counts before it emits them.
TASK_WORDS = 250_000


def misspelt(doc_id: object, word: bytes, every: int = DROP_EVERY) -> bytes:
    """The word, without one code point where ``every`` divides the crc32 of ``<doc_id>:<word>``."""
    h = zlib.crc32(word, zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())))
    if h % every:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = DROP_EVERY) -> DataFrame:
    """``(word, n)`` of the words with so many code points and occurrences at least."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in common.slices(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                # Bytes bound code points from above, and a run only gets shorter.
                found = Counter(w for w in RUNS.findall(text.encode().lower()) if len(w) >= min_length)
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                crc32 = zlib.crc32
                picked = [w for w in found if not crc32(w, start) % every]
                for w in picked:
                    n, changed = found.pop(w), misspelt(doc_id, w, every)
                    counts[changed] += n
                counts.update(found)
                if len(counts) > TASK_WORDS:
                    yield emitted(counts)
                    counts.clear()
        yield emitted(counts)

    def emitted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    found = docs.where("text is not null").select("doc_id", "text").mapInArrow(rows, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _better(n: Column, word: Column) -> Column:
    """Sorts a word of larger n, then of smaller code points, first."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """``(word, near, best)`` of each word's wildcard groups that hold other words."""
    places = words.select("word", "n", F.explode(F.expr("transform(sequence(1, length(word)), i -> struct(i AS position, substring(word, 1, i - 1) AS prefix, substring(word, i + 1) AS suffix))")).alias("g"))
    groups = places.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.slice(F.array_sort(F.collect_list(_better(F.col("n"), F.col("word")))), 1, 2).alias("top")).where("size > 1")
    met = places.join(groups.hint("merge"), "g")
    best = F.when(F.col("top")[0]["word"] == F.col("word"), F.col("top")[1]).otherwise(F.col("top")[0])
    return met.select("word", (F.col("size") - 1).alias("near"), best.alias("best"))


def shortened(words: DataFrame) -> DataFrame:
    """``(word, near, best)`` for both words of each deletion that is a word."""
    deletions = words.select("word", "n", F.explode(F.expr("array_distinct(transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1))))")).alias("shorter"))
    met = deletions.join(words.select(F.col("word").alias("shorter"), F.col("n").alias("shorter_n")).hint("merge"), "shorter")
    side = lambda word, n, other: F.struct(F.col(word).alias("word"), F.lit(1).cast("long").alias("near"), _better(F.col(n), F.col(other)).alias("best"))
    both = F.array(side("word", "shorter_n", "shorter"), side("shorter", "n", "word"))
    return met.select(F.explode(both).alias("s")).select("s.*")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the last word that forms lead to."""
    known = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = known.join(onward.hint("merge"), "root", "left")
        known = common.stored(moved.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of each row of ``(word, n)``."""
    words = common.stored(words, "words")
    near = replaced(words).unionByName(shortened(words)).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    found = words.join(near.hint("merge"), "word", "left")
    taken = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"),
    )
    found = common.stored(found, "forms")
    last = roots(found.where("form is not null"))
    return found.join(last.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
