import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import common, langid, queries, toxicity
from cohortlens.llm.ngrams import WordSums, grams, words_of


def test_grams_are_those_of_each_word():
    words = ["ab", "c", "né"]
    owner, bucket = grams(words, 1, 3, 20)
    expected = {(i, f" {w} "[a:a + n]) for i, w in enumerate(words) for n in (1, 2, 3) for a in range(len(w) + 3 - n) if f" {w} "[a:a + n] != " "}
    assert len(owner) == sum(len([a for n in (1, 2, 3) for a in range(len(w) + 3 - n) if f" {w} "[a:a + n] != " "]) for w in words)
    assert len(set(zip(owner.tolist(), bucket.tolist()))) == len(expected)


def test_word_sums_equal_plain_sums():
    weights = np.random.default_rng(1).normal(size=(1 << 12, 2))
    texts = [["one", "two", "one"], [], ["three"]]
    got = WordSums(weights, 2, 4, 12).sums(texts)
    for row, words in zip(got, texts):
        b = grams(words, 2, 4, 12)[1]
        assert np.allclose(row, [*weights[b].sum(axis=0), len(b)])


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(i % 2, np.array([i % 2, 2 + int(rng.integers(500))]), np.array([1.0, 1.0])) for i in range(400)]
    w = langid.ftrl(rows, 2)
    assert all(np.argmax(x @ w[at]) == y for y, at, x in rows)
    assert w[0, 0] > 0 > w[0, 1] and (w[600:] == 0).all()


def test_temperature_lowers_overconfidence():
    scores = np.array([[9.0, 0], [9.0, 0], [9.0, 0], [0, 9.0]])
    assert langid.temperature(scores, np.array([0, 0, 1, 1])) > 1


def test_language_query(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op10_ftrl_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang and r.text]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= x.score <= 1 for x in got.values())


def test_language_of_odd_rows(odd, none):
    model = langid.train(odd.where(langid.learnable()))
    found = langid.identify(odd, model)
    assert found.columns == [*odd.columns, "lang_pred", "lang_score"] and found.count() == odd.count()
    for r in found.collect():
        assert (r.lang_pred == "und") == (not words_of(r.text)) and 0 <= r.lang_score <= 1
    empty = langid.train(none.where(langid.learnable()))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_toxicity_query(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op2_counterfactual_toxicity(spark, sf).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())


def toy(n=240, mention="muslim"):
    rng = np.random.default_rng(3)
    neutral = [f"w{chr(97 + i)}ord" for i in range(20)]
    rows = []
    for i in range(n):
        words = set(rng.choice(neutral, 6).tolist())
        bad = i % 3 == 0
        if bad:
            words.add("idiot")
        # Group mentions stand mostly in toxic texts: a plain classifier would learn them.
        if rng.random() < (0.9 if bad else 0.1):
            words.add(mention)
        rows.append((int(bad), sorted(words), [mention] if mention in words else []))
    return rows


def score(model, words):
    return float(WordSums(model.weights, toxicity.LOW, toxicity.HIGH, toxicity.BITS).sums([words])[0, 0] + model.intercept)


def test_swaps_keep_mentions_neutral(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.001)
    rows = [(y, [w for w in words if w != "idiot" or i % 2], t) for i, (y, words, t) in enumerate(toy())]
    with_swaps = toxicity.fit(rows)
    monkeypatch.setattr(toxicity, "SWAP", 0.0)
    plain = toxicity.fit(rows)
    change = lambda m: abs(score(m, ["muslim"]) - score(m, ["person"]))
    assert change(with_swaps) < 0.5 * change(plain)
    assert score(with_swaps, ["idiot"]) > score(with_swaps, ["muslim"])


def test_identity_terms_by_sentence():
    assert toxicity.identity_terms("Muslim women sang. A gay man!\nNobody") == ["muslim", "women", "gay", "man"]
    assert toxicity.identity_terms(None) == toxicity.identity_terms("") == []


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, "e"), (1, 0, "e"), (2, None, "e"), (3, 0, "e"), (5, 0, "e"), (None, 1, "e")], "doc_id long, toxic int, text string")
    model = toxicity.train(odd, labels)
    found = toxicity.toxicity(odd, model)
    assert found.count() == odd.count() and all(0 <= r.score <= 1 for r in found.collect())
    assert toxicity.toxicity(none, model).count() == 0
    blank = toxicity.train(odd, labels.where("false"))
    assert all(r.score < 1e-6 for r in toxicity.toxicity(odd, blank).collect())


def test_remainder_is_crc32(spark):
    got = spark.range(50).select("id", common.remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)
