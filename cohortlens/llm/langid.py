"""Operator 10: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three characters, within words): the term frequency
is relative to the text's n-grams, the document frequency is counted over every document that may be learnt from.
The weights are trained with follow-the-regularised-leader under elastic-net penalties, on at most ``PER_LANG``
documents of each language and ``IN_ALL`` in all, chosen by a hash of the id (a documented bound; where there are fewer, all are used). A
fifth of these is held back to fit the temperature that divides the scores before they become probabilities.

A text's score is a sum over its words, so a worker looks at each distinct word once. Nothing is shuffled but the
document frequencies, a number for each bucket and task at most.

Defined results: null text, and text without a letter, gives ``und`` with score 0; a null ``lang`` is not learnt
from; with nothing to learn from every document is ``und``; with one language its score is 1; repeated rows get a
row each; an empty table gives no rows; columns besides doc_id, text and (for learning) lang are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common
from cohortlens.llm.ngrams import CACHE_WORDS, WordSums, grams, words_of

BITS = 16
LOW, HIGH = 1, 3
PER_LANG = 1500
#: Documents learnt from in all, so that many languages don't fill the driver.
IN_ALL = 24_000
SCALE = 10.0
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray
    temperature: float


def document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts, and in how many each bucket's n-grams occur."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, mark = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        known: dict[str, np.ndarray] = {}
        for batch in common.slices(batches, "text", 1 << 20):
            texts = [set(words_of(t)) for t in batch.column("text").to_pylist()]
            new = sorted(set().union(*texts).difference(known))
            if len(known) + len(new) > CACHE_WORDS // 2:
                known.clear()
                new = sorted(set().union(*texts))
            if new:
                owner, bucket = grams(new, LOW, HIGH, BITS)
                order = np.argsort(owner, kind="stable")
                cuts = np.cumsum(np.bincount(owner, minlength=len(new)))[:-1]
                known.update(zip(new, np.split(bucket[order].astype(np.int32), cuts)))
            for words in texts:
                n += 1
                if words:
                    mark[np.concatenate([known[w] for w in words])] = True
                    found = np.flatnonzero(mark)
                    total[found] += 1
                    mark[found] = False
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(counted["bucket"].to_pylist(), counted["n"].to_pylist()))
    n = found.pop(-1, 0)
    df = np.zeros(1 << BITS, np.int64)
    if found:
        df[list(found)] = list(found.values())
    return n, df


def sample(docs: DataFrame, per_lang: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """``(lang, buckets, term frequencies)`` of the sampled documents, in an order of their own."""
    sizes = dict(docs.groupBy("lang").count().collect())
    if not sizes:
        return []
    per_lang = min(per_lang, max(1, IN_ALL // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_lang / n))])
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    chosen = docs.select("lang", "text", place.alias("place")).where(F.col("place") < F.try_element_at(share, F.col("lang")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            buckets, tf = [], []
            for text in batch.column("text").to_pylist():
                count = Counter(words_of(text))
                owner, bucket = grams(list(count), LOW, HIGH, BITS)
                found, at = np.unique(bucket, return_inverse=True)
                weight = np.bincount(at, np.fromiter(count.values(), np.float64, len(count))[owner], len(found))
                buckets.append(found.astype(np.int32))
                tf.append((weight / max(1.0, weight.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("place"), pa.array(buckets, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))], ["lang", "place", "buckets", "tf"]
            )

    got = chosen.mapInArrow(rows, "lang string, place double, buckets array<int>, tf array<float>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i, p=got["place"].to_pylist(), s=got["lang"].to_pylist(), b=got["buckets"]: (p[i], s[i], len(b[i])))
    langs, buckets, tf = got["lang"].to_pylist(), got["buckets"], got["tf"]
    return [(langs[i], np.asarray(buckets[i].values), np.asarray(tf[i].values, np.float64)) for i in order]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int) -> np.ndarray:
    """Weights by FTRL-proximal: each coordinate has its own step, L1 makes weights exactly zero, L2 shrinks them."""
    z = np.zeros((1 << BITS, n_classes))
    n = np.zeros((1 << BITS, n_classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.sign(z) * L1 - z
        w /= (BETA + np.sqrt(n)) / ALPHA + L2
        w[np.abs(z) <= L1] = 0
        return w

    for _ in range(EPOCHS):
        for y, at, x in rows:
            za, na = z[at], n[at]
            w = weights(za, na)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            squared = g * g
            g -= (np.sqrt(na + squared) - np.sqrt(na)) / ALPHA * w
            z[at] = za + g
            n[at] = na + squared
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores under which held-back documents are likeliest."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def learnable(held_out: Column | None = None) -> Column:
    held_out = common.remainder(F.col("doc_id"), FOLDS) == HELD_OUT if held_out is None else held_out
    return ~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from ``docs`` (doc_id, text, lang), all of which may be learnt from."""
    found = sample(docs, per_lang)
    langs = sorted({x[0] for x in found})
    if not found:
        return Model([], np.zeros((1 << BITS, 0)), 1.0)
    n, df = document_frequency(docs)
    idf = SCALE * (np.log((1 + n) / (1 + df)) + 1)
    number = {x: i for i, x in enumerate(langs)}
    rows = [(number[lang], at, tf * idf[at]) for lang, at, tf in found]
    fit, back = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    weights = ftrl(fit or rows, len(langs))
    scores = np.array([x @ weights[at] for _, at, x in back])
    return Model(langs, weights * idf[:, None], temperature(scores, np.array([y for y, *_ in back])))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and lang_score under free names, last."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(F.struct(*[common.col(docs, c) for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    table: list[WordSums] = []

    @F.pandas_udf("lang_pred string, lang_score double")
    def predict(texts):
        import pandas as pd

        m = sent.value
        if not table:
            table.append(WordSums(m.weights, LOW, HIGH, BITS))
        pred, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        for a, b in common.spans([len(t or "") for t in texts], 1 << 20):
            words = [words_of(t) for t in texts.iloc[a:b]]
            known = [i for i, w in enumerate(words) if w] if m.langs else []
            if known:
                sums = table[0].sums([words[i] for i in known])
                p = softmax(sums[:, :-1] / sums[:, -1:] / m.temperature)
                at = np.array(known) + a
                pred[at], score[at] = np.array(m.langs, object)[p.argmax(axis=1)], p.max(axis=1)
        return pd.DataFrame({"lang_pred": pred, "lang_score": score})

    found = whole.select("row", predict("text").alias("p"))
    pred = common.fresh(docs, "lang_pred")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("p.lang_pred").alias(pred), F.col("p.lang_score").alias(common.fresh(docs, "lang_score")))
