"""Operator 13 against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from cohortlens.llm import common, queries, variants


def near(a, b):
    """Exactly one code point replaced, inserted or deleted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts, ratio=5):
    found = {}
    for w, n in counts.items():
        others = sorted((-m, o) for o, m in counts.items() if near(w, o))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        found[w] = n, len(others), best and best[1], best and -best[0]
    rows = set()
    for w, (n, k, form, form_n) in found.items():
        root = w
        while found[root][2]:
            root = found[root][2]
        rows.add((w, n, k, form, form_n, root))
    return rows


def rows_of(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words(spark, seed):
    rng = random.Random(seed)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(2, 6))): 5 ** rng.randint(0, 5) + rng.randint(0, 2) for _ in range(150)}
    counts |= {"aaaaaaa": 10, "aaaaaa": 10, "aaaaab": 10}  # repeated letters, ties
    assert rows_of(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_forms_lead_to_the_last(spark):
    counts = {"abcdef": 5**6, "abcdeg": 5**5, "abcdhg": 5**4, "abcihg": 5**3, "abjihg": 5**2, "akjihg": 5, "zzzzzz": 9}
    found = {r["word"]: r["root"] for r in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert found == {w: "abcdef" for w in counts} | {"zzzzzz": "zzzzzz"}


def words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_query(spark, sf, docs):
    counts = words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(queries.op13_spelling_variants(spark, sf)) == brute(counts)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = {r["word"]: r["n"] for r in variants.vocabulary(odd, min_count=1, min_length=1).collect()}
    expected = Counter()
    for i, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate({c: c + 32 for c in range(65, 91)})):
            expected[variants.misspelt(i, run.encode()).decode()] += 1
    assert found == {w: n for w, n in expected.items() if w}
    assert rows_of(variants.variants(variants.vocabulary(odd))) == brute(words(rows))
    assert rows_of(variants.variants(variants.vocabulary(none))) == set()


def test_counts_do_not_depend_on_batches(odd, monkeypatch):
    whole = set(variants.vocabulary(odd, 1, 1).collect())
    monkeypatch.setattr(variants, "TASK_WORDS", 1)
    assert set(variants.vocabulary(odd, 1, 1).collect()) == whole


def test_no_join_is_a_broadcast(spark, monkeypatch):
    """Files of a few bytes say nothing of the rows that an explode makes of them."""
    plans, stored = [], common.stored
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(common, "stored", lambda df, *a, **k: (planned(df), stored(df, *a, **k))[1])
    counts = {"abcdef": 5**6, "abcdeg": 5**5, "abcdhg": 5**4, "abcde": 5**3, "zzzzzz": 9}
    planned(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
