"""Operator 11: a Merkle manifest of a dataset, built and verified by Pregel-style RDD supersteps.

Each row is a leaf; the leaves of a tree (a language) ascend by doc_id; runs of ``fanout`` nodes have a parent, up to one
node, the subroot; the subroots, in the order of their languages, are the leaves of one more tree with the root.

* Leaves are hashed by Spark's own functions, dealt by range over (tree, doc_id, digest) and numbered within the parts; a
  row for each tree and part says where a part begins, so that no task holds a tree.
* Upward supersteps: a node sends ``(slot, digest)`` to its parent. Messages are combined before the shuffle (neighbours lie
  in one part), a parent that has all its children hashes them, and goes forward into the next superstep. Nodes without
  a sibling anywhere (roots) halt.
* Downward supersteps: a parent sends each child the path from that child's parent to the root, as ``(slot, others)`` by
  level, and last the leaves of a run meet the path of their run. There each leaf folds its claimed digest up the path.

Each superstep is written to the shared folder: a lost executor costs a superstep at most, and plans don't grow. Supersteps
number about log8 of the largest tree; the driver learns counts alone and, at the end, the root.

A digest is the lowercase hex sha256 of its inputs, concatenated as hex text; nodes are kept as 32 bytes.

Defined results: nulls hash as ``-``, an empty text as ``0:``, texts of any length are hashed whole; a null doc_id comes
before all others and a null tree before all others; rows of one doc_id in a tree are ordered by their digests, so that
repeated rows are leaves of their own and the root doesn't depend on how rows are dealt; an empty table has no leaf and the root
None; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm import common

FANOUT = 8
#: Nodes that a task of a superstep holds, on average.
TASK_NODES = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<slot:int,others:binary>"


def leaf_digest(columns: Iterable[Column]) -> Column:
    """Lowercase hex sha256 of the columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def digest_of(digests: bytes) -> bytes:
    """H of nodes that are kept side by side."""
    return hashlib.sha256(digests.hex().encode()).digest()


def _tasks(nodes: int) -> int:
    return max(1, -(-nodes // TASK_NODES))


def numbered(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (tree, doc_id, digest, any others) with their place ``idx`` in the tree and the tree's ``n``."""
    parts = leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # The last key parts rows that are alike; their order is of no account, as their digests are the same.
    drawn = common.stored(leaves.withColumn("drawn", F.monotonically_increasing_id()), "leaves")
    order = ["tree", "doc_id", "digest", "drawn"]
    placed = drawn.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = common.stored(placed.drop("drawn").withColumn("part", F.shiftright("at", 33)), "numbered")
    begun = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select(F.col("part").alias("p"), F.col("tree").alias("t"), "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    joined = placed.join(begun, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    return joined.select(*[c for c in placed.columns if c not in ("at", "part")], (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "n")


def _level(found: RDD, spark, tree_type: str, name: str) -> DataFrame:
    schema = f"tree {tree_type}, idx long, n long, digest binary, children binary"
    return common.stored(spark.createDataFrame(found, schema, verifySchema=False), name)


def up(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above ``leaves`` (tree, idx, n, digest), from their parents to the last root; ``n`` counts a tree's nodes at the level."""
    spark, kind = leaves.sparkSession, leaves.schema["tree"].dataType.simpleString()
    levels: list[DataFrame] = []
    active = leaves.where("n > 1").select("tree", "idx", "n", "digest")
    nodes = active.count()

    def message(row) -> tuple[tuple, list[tuple[int, bytes]]]:
        return (row.tree, row.idx // fanout, row.n), [(row.idx % fanout, bytes(row.digest))]

    def hashed(parent: tuple[tuple, list[tuple[int, bytes]]]) -> tuple:
        (tree, idx, n), got = parent
        if len(got) != min(fanout, n - idx * fanout):
            raise ValueError(f"tree {tree!r}: {len(got)} children at {idx}")
        children = b"".join(d for _, d in sorted(got))
        return tree, idx, -(-n // fanout), digest_of(children), children

    while nodes:
        parents = active.rdd.map(message).reduceByKey(lambda a, b: a + b, _tasks(nodes)).map(hashed)
        levels.append(_level(parents, spark, kind, f"merkle-{len(levels) + 1}"))
        active = levels[-1].where("n > 1").select("tree", "idx", "n", "digest")
        nodes = active.count()
    return levels


def down(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``(tree, idx, children, subroot, path)`` of the lowest level: the path leads from a parent of leaves to the root.

    ``tops`` (tree, subroot, path) is what each tree's root is sent from above.
    """
    spark, kind = tops.sparkSession, tops.schema["tree"].dataType.simpleString()
    schema = f"tree {kind}, idx long, children binary, subroot binary, path array<{_STEP}>"
    tops = tops.rdd.map(lambda r: ((r.tree, 0), (bytes(r.subroot), [tuple(s) for s in r.path])))
    sent = None

    def siblings(row: tuple) -> Iterator[tuple]:
        tree, idx, children, subroot, path = row
        for slot in range(len(children) // 32):
            step = slot, children[:32 * slot] + children[32 * slot + 32:]
            yield (tree, idx * fanout + slot), (bytes(subroot), [step, *(tuple(s) for s in path)])

    def meet(found: tuple) -> Iterator[tuple]:
        (tree, idx), (states, messages) = found
        for children, (subroot, path) in zip(states, messages):
            yield tree, idx, children, subroot, path

    for level in reversed(levels):
        states = level.rdd.map(lambda r: ((r.tree, r.idx), bytes(r.children)))
        roots = level.where("n = 1").rdd.map(lambda r: ((r.tree, r.idx), bytes(r.children)))
        tasks = _tasks(level.count())
        got = roots.cogroup(tops, tasks).flatMap(meet)
        if sent is not None:
            got = got.union(states.cogroup(sent.rdd.flatMap(siblings), tasks).flatMap(meet))
        sent = common.stored(spark.createDataFrame(got, schema, verifySchema=False), "merkle-paths")
    return sent if sent is not None else spark.createDataFrame([], schema)


class Manifest:
    """The tree over ``leaves`` (tree, doc_id, digest and any other columns)."""

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT):
        self.fanout = fanout
        self.leaves = common.stored(numbered(leaves, fanout), "merkle-leaves")
        self.levels = up(self.leaves, fanout)
        own = [x.where("n = 1").select("tree", "digest") for x in [self.leaves, *self.levels]]
        self.subroots = common.stored(numbered(reduce(DataFrame.unionByName, own).select(F.lit(0).alias("tree"), F.col("tree").alias("doc_id"), "digest")), "merkle-subroots")
        self.top = up(self.subroots, fanout)
        last = [r[0] for x in [self.subroots, *self.top] for r in x.where("n = 1").select("digest").take(1)]
        #: Hex; None without leaves.
        self.root: str | None = bytes(last[0]).hex() if last else None

    def paths(self) -> DataFrame:
        """``(tree, subroot, path)`` from each tree's root to the root of all."""
        spark = self.leaves.sparkSession
        start = spark.createDataFrame([(0, bytearray(32), [])], f"tree int, subroot binary, path array<{_STEP}>")
        runs = down(self.top, start, self.fanout).select(F.col("idx").alias("run"), "children", "path")
        own = self.subroots.select(F.col("doc_id").alias("tree"), F.col("digest").alias("subroot"), "idx", F.floor(F.col("idx") / self.fanout).alias("run"))
        return own.join(runs, "run", "left").select("tree", "subroot", self._step("idx").alias("path"))

    def _step(self, idx: str) -> Column:
        """The path of a child of the run ``children``, whose own path is ``path``; empty where there is no run."""
        slot = (F.col(idx) % self.fanout).cast("int")
        others = F.concat(F.substring("children", F.lit(1), 32 * slot), F.substring("children", 32 * slot + 33, F.length("children")))
        return F.when(F.col("children").isNull(), F.array().cast(f"array<{_STEP}>")).otherwise(F.concat(F.array(F.struct(slot.alias("slot"), others.alias("others"))), F.col("path")))

    def verified(self, claimed: str = "digest") -> DataFrame:
        """The leaves' other columns with leaf, subroot, root, proof_sha256, folded_root and verified.

        ``claimed`` names the leaves' column of digests that are folded up the original siblings.
        """
        tops = common.stored(self.paths(), "merkle-tops")
        lone = self.leaves.where("n = 1")
        runs = down(self.levels, tops, self.fanout)
        more = [c for c in self.leaves.columns if c not in ("tree", "idx", "n", "digest", claimed)]
        schema = ", ".join(f"`{c}` {self.leaves.schema[c].dataType.simpleString()}" for c in more)
        schema += ", leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        fanout, root = self.fanout, self.root

        def state(row) -> tuple[int, bytes, bytes, tuple]:
            return row.idx, bytes(row.digest), bytes(row[claimed]), tuple(row[c] for c in more)

        def row(leaf: tuple, path: list[tuple[int, bytes]], subroot: bytes) -> tuple:
            _, digest, node, values = leaf
            others = b"".join(o for _, o in path)
            for slot, run in path:
                node = digest_of(run[:32 * slot] + node + run[32 * slot:])
            return (*values, digest.hex(), subroot.hex(), root, digest_of(others).hex(), node.hex(), node.hex() == root)

        def run_of(found: tuple) -> Iterator[tuple]:
            _, (leaves, messages) = found
            for children, subroot, path in messages:
                for leaf in leaves:
                    slot = leaf[0] % fanout
                    yield row(leaf, [(slot, children[:32 * slot] + children[32 * slot + 32:]), *path], subroot)

        def alone(found: tuple) -> Iterator[tuple]:
            _, (leaves, messages) = found
            for subroot, path in messages:
                for leaf in leaves:
                    yield row(leaf, path, subroot)

        states = self.leaves.where("n > 1").rdd.map(lambda r: ((r.tree, r.idx // fanout), state(r)))
        sent = runs.rdd.map(lambda r: ((r.tree, r.idx), (bytes(r.children), bytes(r.subroot), [(s.slot, bytes(s.others)) for s in r.path])))
        out = states.cogroup(sent, _tasks(self.leaves.count())).flatMap(run_of)
        ones = lone.rdd.map(lambda r: (r.tree, state(r))).cogroup(tops.rdd.map(lambda r: (r.tree, (bytes(r.subroot), [(s.slot, bytes(s.others)) for s in r.path]))), _tasks(tops.count()))
        return self.leaves.sparkSession.createDataFrame(out.union(ones.flatMap(alone)), schema, verifySchema=False)


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, doc_id, digest and claimed: the latter of the row with its text's A-Z lower-cased where ``tampered`` holds."""
    columns = {c: F.col(c) for c in FIELDS}
    digest = leaf_digest(columns.values())
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = digest if tampered is None else F.when(tampered, leaf_digest((columns | {"text": lower}).values())).otherwise(digest)
    return docs.select(F.col("lang").alias("tree"), "doc_id", F.unhex(digest).alias("digest"), F.unhex(claimed).alias("claimed"))
