"""Operator 11 against a plain tree, built level by level."""

import hashlib
import zlib
from itertools import groupby

import pytest

from cohortlens.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    if lower and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each leaf its run at each level with its place in it."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for s, i in zip(steps, at):
            s.append((i % 8, runs[i // 8]))
        nodes, at = [h(*r) for r in runs], [i // 8 for i in at]
    return nodes[0], steps


def expected(rows):
    tampered = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    key = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    trees = []
    for _, group in groupby(sorted(rows, key=key), key):
        group = sorted(group, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((group, *tree([leaf(r) for r in group])))
    root, tops = tree([t[1] for t in trees])
    found = []
    for (group, subroot, steps), top in zip(trees, tops):
        for r, own in zip(group, steps):
            node, proof = leaf(r, tampered(r)), []
            for slot, run in [*own, *top]:
                proof += run[:slot] + run[slot + 1:]
                node = h(*run[:slot], node, *run[slot + 1:])
            found.append((r["doc_id"], leaf(r), subroot, root, h(*proof), node, node == root))
    return found


def order(rows):
    return sorted(map(tuple, rows), key=str)


def given(df):
    return order(merkle.Manifest(merkle.leaves_of(df, queries.tampered())).verified("claimed").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_query(spark, sf, docs):
    found = order(queries.op11_merkle_manifest(spark, sf).collect())
    assert found == order(expected(docs.collect()))
    assert {r[-1] for r in found} == {True, False}


def test_odd_rows(odd):
    assert given(odd) == order(expected(odd.collect()))


def test_no_rows(none):
    manifest = merkle.Manifest(merkle.leaves_of(none))
    assert manifest.root is None and manifest.verified("claimed").count() == 0


@pytest.mark.parametrize(("n", "langs"), [(1, 1), (8, 1), (9, 1), (65, 1), (9, 9), (150, 70)])
def test_shapes(spark, n, langs):
    rows = [(i * 7 - 20, f"Text {i}", None if i % langs == 3 else f"l{i % langs}", "s", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert given(df) == order(expected(df.collect()))


def test_the_root_does_not_depend_on_how_rows_are_dealt(docs):
    rows = docs.limit(60)
    rows = rows.unionByName(rows.limit(20))
    assert merkle.Manifest(merkle.leaves_of(rows.repartition(7))).root == merkle.Manifest(merkle.leaves_of(rows.coalesce(1))).root


def test_a_forged_digest_is_found_everywhere(docs):
    leaves = merkle.leaves_of(docs.limit(30))
    forged = merkle.Manifest(leaves.selectExpr("tree", "doc_id", "digest", "unhex(sha2(claimed, 256)) AS claimed")).verified("claimed")
    assert forged.where("verified").count() == 0 and forged.count() == 30
