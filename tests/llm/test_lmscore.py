"""Operator 12 against a plain model in dictionaries; the trie level against a search of all its n-grams."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common, lmscore, queries
from cohortlens.llm.eliasfano import STEPS, EliasFano, Level


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plain(rows, order):
    """(doc_id, learnt, n_tokens, n_known, base, score) of (doc_id, text, learn)."""
    counts = Counter()
    for _, text, learn in rows:
        if learn:
            t = tokens(text)
            counts.update(tuple(t[i:i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)

    def p(h, w):
        if not h:
            return (counts[w,] + 1) / (n + v + 1)
        lower = p(h[1:], w)
        return (counts[*h, w] + lmscore.MU * lower) / (counts[h] + lmscore.MU) if counts[h] else lower

    found = []
    for doc_id, text, learn in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w,] + 1) / (n + v + 1)) for w in t)
        found.append((doc_id, learn, len(t), sum(counts[w,] > 0 for w in t), base, sum(math.log10(p(tuple(t[max(0, i - order + 1):i]), w)) for i, w in enumerate(t))))
    return n, found


def compared(df, rows, order):
    n, expected = plain(rows, order)
    got = df.collect()
    assert {r["train_tokens"] for r in got} <= {n}
    key = lambda r: (str(r[0]), r[2], r[4], r[5])
    got = sorted(((r["doc_id"], r["learnt"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6) and abs(a[5] - b[5]) <= b[2] * order / STEPS


@pytest.mark.parametrize("order", [1, 2, 3])
def test_random_texts(spark, order, monkeypatch):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", 40)  # many blocks and shards, and contexts over several shards
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("a a a a b B c d é zz".split()) for _ in range(rng.randint(0, 40))), rng.random() < 0.7) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    compared(lmscore.score(df, F.col("learn"), order), rows, order)


def test_two_words_of_context_count(spark):
    """After ``a`` alone b and c are as likely; what stands before it tells them apart."""
    learn = [(i, "x a b y a c", True) for i in range(40)]
    rows = [*learn, (100, "x a b", False), (101, "x a c", False)]
    got = {r["doc_id"]: r["score"] for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), F.col("learn")).collect()}
    known = lmscore.score(spark.createDataFrame([*learn, (100, "y a c", False), (101, "y a b", False)], "doc_id long, text string, learn boolean"), F.col("learn"))
    other = {r["doc_id"]: r["score"] for r in known.collect()}
    assert got[100] - got[101] + other[100] - other[101] > 0.1  # 0 where a context is one word


def test_ngrams_of_one_block_are_not_sent():
    """Words that no other block has settle all n-grams that hold them: nothing goes to a shard, and the sums are whole."""
    text, learnt = b"a b a c", lmscore._pack(np.ones(1, np.uint8))
    words, seq = [b"", b"a", b"b", b"c"], np.array([1, 2, 1, 3, 0], np.uint32)
    block = lmscore._Block({"block": 7, "words": lmscore._pack(np.frombuffer(b"\n".join(words), np.uint8)), "seq": lmscore._pack(seq), "sizes": lmscore._pack(np.array([5], np.uint32)), "held": learnt}, 1, 5, 4)
    block.learn_words([lmscore._pack(np.zeros(4, np.int64), np.zeros(4, np.int64))])
    for k in (2, 3):
        block.grams()
        assert not list(block.messages())
        if k == 2:
            block.learn([])
    _, (expected,) = plain([(1, text.decode(), True)], 3)
    learnt, *got = (x[0] for x in lmscore._scores(block.rest(3), []))
    assert learnt and tuple(got[:2]) == expected[2:4] and got[2] == pytest.approx(expected[4]) and abs(got[3] - expected[5]) <= 15 / STEPS


def test_only_the_last_tables_stay(spark, tmp_path, monkeypatch):
    """Blocks and answers of lower orders stayed beside the last order's messages, which took more disk than the limit."""
    monkeypatch.setattr(common, "new_path", lambda spark, name: f"{tmp_path}/{name}-{time.time_ns()}")
    rows = [(i, "a b a c b"[: 2 * i], True) for i in range(5)]
    compared(lmscore.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(2), F.col("learn")), rows, lmscore.ORDER)
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == ["lm-answers", "lm-last"]


@pytest.mark.parametrize("text", [" a\x0b\x1cB\t\x85 \xa0É", "", "\n \r\x0c", "a  a"])
def test_numbered_words(text):
    words, seq, sizes = lmscore._numbered(pa.array(["pad", "B a", text]).slice(1))
    held = words.tobytes().split(b"\n")
    expected = [[(t or "").encode() for t in tokens(x)] for x in ("B a", text)]
    assert held[0] == b"" and len(set(held)) == len(held) and lmscore._lines(words).to_pylist() == held
    assert [held[i] for i in seq] == sum(expected, []) and sizes.tolist() == [len(x) for x in expected]


def test_query(spark, sf, docs):
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in docs.select("doc_id", "text").collect()]
    found = queries.op12_elias_fano_lm(spark, sf)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compared(found.withColumn("learnt", ~F.col("held_out")), rows, lmscore.ORDER)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"], r["lang"] == "en") for r in odd.collect()]
    compared(lmscore.score(odd, F.col("lang") == "en", 3), rows, 3)
    compared(lmscore.score(odd, F.lit(True)), [(*r[:2], True) for r in rows], 2)
    assert lmscore.score(none, F.lit(True)).count() == 0


def test_nothing_to_learn_from(odd):
    assert {(r["base_score"], r["score"], r["train_tokens"]) for r in lmscore.score(odd, F.lit(None).cast("boolean")).collect()} == {(0.0, 0.0, 0)}


@pytest.mark.parametrize(("n", "top"), [(1, 1), (5, 3), (1000, 10**6), (1000, 1000), (300, 10**12)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    found = EliasFano("x", EliasFano.arrays("x", values))
    assert (found[np.arange(n)] == values).all()
    x, a = rng.integers(0, top + 5, 300), rng.integers(0, n, 300)
    b = np.minimum(n, a + rng.integers(0, n + 1, 300))
    assert found.successor(x, a, b).tolist() == [next((i for i in range(s, e) if values[i] >= v), e) for v, s, e in zip(x, a, b)]


def test_level():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 50, 2000) * 10**6 + rng.integers(0, 10**6, 2000) // 1000)
    h, w, counts = key // 10**6, key % 10**6, rng.integers(1, 100, len(key))
    level = Level(Level.file(h, w, counts / 100, counts))
    assert level.find(h, w).tolist() == list(range(len(key))) and (level.counts(np.arange(len(key))) == counts).all()
    assert np.abs(10.0 ** (-level.codes.astype(float) / STEPS) - counts / 100).max() < 0.001
    there = {k: i for i, k in enumerate(zip(h.tolist(), w.tolist()))}
    asked = rng.integers(0, 60, 3000), rng.integers(0, 1100, 3000)
    assert level.find(*asked).tolist() == [there.get(k, -1) for k in zip(*(x.tolist() for x in asked))]
    assert level.bytes < 6 * len(key)
