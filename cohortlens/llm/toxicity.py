"""Operator 2: a counterfactual-regularised toxicity classifier.

A text is the set of its words; a word's score is the sum of the weights of its hashed character n-grams (four to
eight characters with a space on either side, so that stems and whole words of any language can be learnt), a text's
score the sum of its words' scores. Training minimises the logistic loss plus L1 and L2 penalties plus, for each
identity term in a sentence of a labelled text, the squared change of the sentence's score when the term is swapped
for another of its group or for a neutral noun: group mentions by themselves stop moving the score.

At most ``ROWS`` labelled rows are learnt from, chosen by a hash of the id (a documented bound; where there are
fewer, all are used). They are fitted on the driver; scoring is a map over all texts.

Defined results: null and empty text score the intercept alone; rows of ``labels`` without a label are not learnt
from; with nothing to learn from, or one label alone, every score is 0 or near that label; where ids repeat, each pair of a label and a text is learnt from;
repeated rows get a row each; an empty table gives no rows; columns besides doc_id, text and toxic are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common
from cohortlens.llm.ngrams import WordSums, grams, words_of

BITS = 20
LOW, HIGH = 4, 8
ROWS = 5_000
ROUNDS, ACTIVE, STEPS = 6, 400, 120
#: The L1 penalty is at least 1 / sqrt(rows): below that, chance alone lifts n-grams.
L1, L2 = 0.02, 1e-4
#: Weight of the counterfactual penalty against the mean loss of a text.
SWAP = 1.0
FOLDS, HELD_OUT = 5, 0
#: Identity terms by group, and the nouns that name a person without one.
IDENTITIES = {
    "religion": "christian christians muslim muslims jewish jew jews hindu hindus buddhist buddhists atheist atheists catholic catholics sikh sikhs",
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary",
    "orientation": "gay gays lesbian lesbians bisexual queer straight heterosexual homosexual",
    "origin": "african africans american americans arab arabs asian asians black european europeans immigrant immigrants indian indians latino latinos mexican mexicans native refugee refugees white",
    "age and health": "old elderly young disabled blind deaf autistic",
}
NEUTRAL = "person people someone"
_GROUP = {t: g for g, terms in IDENTITIES.items() for t in terms.split()}
_SWAPS = {g: [*terms.split(), *NEUTRAL.split()] for g, terms in IDENTITIES.items()}
_SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float


def identity_terms(text: str | None) -> list[str]:
    """The identity terms of each sentence, once for each sentence that has them."""
    if not text or not _GROUP.keys() & set(words_of(text)):
        return []
    return [w for s in _SENTENCE.split(text) for w in sorted(_GROUP.keys() & set(words_of(s)))]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> list[tuple[int, list[str], list[str]]]:
    """``(label, words, identity terms)`` of the rows to learn from; ``labels`` holds only such."""
    known = labels.where(F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    n = known.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    # About ``rows`` rows at any size of the tables, as an id has at most two.
    known = known.select("doc_id", "toxic", place.alias("place")).where(F.col("place") < min(1.0, rows / max(n, 1)))
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            columns = [pa.array([sorted(set(words_of(t))) for t in texts], pa.list_(pa.string())), pa.array(map(identity_terms, texts), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), *columns], ["place", "toxic", "words", "terms"])

    got = chosen.select("place", "toxic", "text").mapInArrow(bags, "place double, toxic int, words array<string>, terms array<string>").toArrow().to_pylist()
    return [(x["toxic"], x["words"], x["terms"]) for x in sorted(got, key=lambda x: (x["place"], x["toxic"], x["words"]))]


class _Problem:
    """Loss and penalties over a growing set of active n-grams, each scaled by its weighted frequency."""

    def __init__(self, rows: list[tuple[int, list[str], list[str]]]):
        swaps: Counter = Counter()
        for _, _, terms in rows:
            for a in terms:
                others = [b for b in _SWAPS[_GROUP[a]] if b != a]
                swaps.update({(a, b): 1 / len(others) for b in others})
        vocabulary = sorted(set().union(*(w for _, w, _ in rows), *swaps))
        number = {w: i for i, w in enumerate(vocabulary)}
        self.owner, bucket = grams(vocabulary, LOW, HIGH, BITS)
        self.used, self.slot = np.unique(bucket, return_inverse=True)
        self.n_words, self.n_docs = len(vocabulary), len(rows)
        self.y = np.array([r[0] for r in rows], float)
        sizes = [len(r[1]) for r in rows]
        self.doc = np.repeat(np.arange(len(rows)), sizes)
        self.word = np.fromiter((number[w] for _, words, _ in rows for w in words), np.int64, sum(sizes))
        self.weight = np.where(self.y > 0, 0.5 / self.y.sum(), 0.5 / (1 - self.y).sum())
        self.first = np.array([number[a] for a, _ in swaps], np.int64)
        self.second = np.array([number[b] for _, b in swaps], np.int64)
        self.times = np.array(list(swaps.values())) * SWAP / len(rows)
        seen = self.gradient(self.weight)  # 0 for n-grams of swapped-in terms alone
        self.scale = np.where(seen > 0, 1 / np.sqrt(np.maximum(seen, 1e-12)), 0)

    def gradient(self, residual: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """By n-gram: sums of the documents' residuals, and with weights ``w`` the change of the swap penalty."""
        by_word = np.bincount(self.word, residual[self.doc], self.n_words)
        if w is not None and len(self.times):
            score = np.bincount(self.owner, w[self.slot], self.n_words)
            change = 2 * self.times * (score[self.first] - score[self.second])
            by_word += np.bincount(self.first, change, self.n_words) - np.bincount(self.second, change, self.n_words)
        return np.bincount(self.slot, by_word[self.owner], len(self.used))

    def restrict(self, active: np.ndarray) -> None:
        """Sparse matrices of the active n-grams: documents, and swapped pairs of words."""
        k = len(active)
        at = np.full(len(self.used), -1)
        at[active] = np.arange(k)
        mine = at[self.slot] >= 0
        order = np.argsort(self.owner[mine], kind="stable")
        owner, gram = self.owner[mine][order], at[self.slot[mine]][order]
        per_word = np.bincount(owner, minlength=self.n_words)
        start = np.cumsum(per_word) - per_word

        def expand(row: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> tuple:
            times = per_word[word]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[word], times)
            key, inverse = np.unique(np.repeat(row, times) * k + gram[place], return_inverse=True)
            return key // k, key % k, np.bincount(inverse, np.repeat(value, times), len(key)) * self.scale[active][key % k], n

        pairs = np.arange(len(self.times))
        self.x = expand(self.doc, self.word, np.ones(len(self.doc)), self.n_docs)
        self.d = expand(np.append(pairs, pairs), np.append(self.first, self.second), np.repeat([1.0, -1.0], len(pairs)), len(pairs))
        self.k = k

    def times_(self, m: tuple, v: np.ndarray) -> np.ndarray:
        row, column, value, n = m
        return np.bincount(row, value * v[column], n)

    def back(self, m: tuple, u: np.ndarray) -> np.ndarray:
        row, column, value, _ = m
        return np.bincount(column, value * u[row], self.k)

    def swapped(self, v: np.ndarray) -> np.ndarray:
        return self.back(self.d, 2 * self.times * self.times_(self.d, v)) if len(self.times) else np.zeros(self.k)

    def curvature(self) -> float:
        v, size = np.random.default_rng(0).normal(size=self.k), 1.0
        for _ in range(12):
            v = v / np.linalg.norm(v)
            v = self.back(self.x, self.weight * self.times_(self.x, v)) / 4 + self.swapped(v)
            size = float(np.linalg.norm(v))
        return 1.2 * size + 1

    def descend(self, w: np.ndarray, b: float, l1: float) -> tuple[np.ndarray, float]:
        """Accelerated proximal steps (FISTA)."""
        rate = 1 / self.curvature()
        v, vb, t = w, b, 1.0
        for _ in range(STEPS):
            s = self.times_(self.x, v) + vb
            r = self.weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - self.y)
            new = v - rate * (self.back(self.x, r) + self.swapped(v) + L2 * v)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            new_b = vb - rate * r.sum()
            t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            v, vb = new + (old - 1) / t * (new - w), new_b + (old - 1) / t * (new_b - b)
            w, b = new, new_b
        return w, b

    def residual(self, w: np.ndarray, b: float) -> np.ndarray:
        s = np.bincount(self.doc, np.bincount(self.owner, w[self.slot], self.n_words)[self.word], self.n_docs) + b
        return self.weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - self.y)


def fit(rows: list[tuple[int, list[str], list[str]]]) -> Model:
    """L1-penalised fit by growing the set of active n-grams by those that break the optimum's conditions most."""
    weights = np.zeros((1 << BITS, 1))
    if not rows or len({y for y, *_ in rows}) < 2 or not any(w for _, w, _ in rows):
        mean = float(np.mean([y for y, *_ in rows])) if rows else 0.0
        return Model(weights, 0.0 if 0 < mean < 1 else 20.0 if mean else -20.0)
    p = _Problem(rows)
    l1 = max(L1, 1 / np.sqrt(len(rows)))
    w, b, active = np.zeros(len(p.used)), 0.0, np.empty(0, np.int64)
    for _ in range(ROUNDS):
        broken = np.abs(p.gradient(p.residual(w, b), w)) * p.scale - l1
        broken[active] = 0
        new = np.argsort(-broken, kind="stable")[:ACTIVE]
        new = new[broken[new] > 0]
        if not len(new):
            break
        active = np.sort(np.append(np.flatnonzero(w), new))
        p.restrict(active)
        found, b = p.descend(w[active] / p.scale[active], b, l1)
        w = np.zeros(len(p.used))
        w[active] = found * p.scale[active]
    active = np.flatnonzero(w)
    if len(active):  # what was selected is fitted again under a small penalty, which shrinks less
        p.restrict(active)
        found, b = p.descend(w[active] / p.scale[active], b, l1 / 10)
        w[active] = found * p.scale[active]
    weights[p.used, 0] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    return fit(labelled(docs, labels, rows))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordSums(sent.value.weights, LOW, HIGH, BITS)
        for batch in common.slices(batches, "text", 1 << 20):
            s = table.sums([set(words_of(t)) for t in batch.column("text").to_pylist()])[:, 0] + sent.value.intercept
            score = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return kept.mapInArrow(rows, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")
