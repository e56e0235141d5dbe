"""Operator 7: runs of lines that were seen before are deleted, by winnowing over line hashes.

Lines are compared without white space around them; blank lines take no part. A run counts from ``min_words``
words on, over however many lines. The winnowing window is measured in words likewise: from each line forward, and
from each line backward, the fewest lines that hold ``min_words`` words. Each window selects its line of the
smallest hash as its fingerprint. Every repeated run is covered by windows that lie wholly inside it (its first
line's forward window, and the backward windows of the lines behind that), and equal windows select equal
fingerprints, so no repeated run goes unseen, and a line whose fingerprint is unique is never looked at again.

Positions are joined on the fingerprint; the windows around a repeated fingerprint, by their digests, find the
first place of each window's lines. A window that stands elsewhere first is matched; the matched windows around
one fingerprint overlap and reach as far both ways as the lines agree, so their union is the whole repeated run.
The union's lines are deleted, save where a window overlaps its own first place. Each line's first place is
before all matches, so every distinct line stays at least once.

Documents are ordered by doc_id, nulls last, then by a hash of the text; earlier means in that order, then by
line. The hot window of a passage that a third of the documents share is counted by partial aggregation and then
joined as a skewed key, which Spark splits; no group is gathered.

Defined results: null text stays null and has no lines; rows that agree in doc_id and text are one document and
are cut alike; other columns are kept as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

MIN_WORDS = 50


def windows(text: str, min_words: int) -> list[tuple[int, list[tuple[bytes, int, int]]]]:
    """``(fingerprint, [(digest, first line, line behind the last), ...])`` of a text; lines are counted from 0."""
    lines = text.split("\n")
    kept = [(i, x) for i, line in enumerate(lines) if (x := line.strip())]
    words = np.array([len(x.split()) for _, x in kept], np.int64)
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(kept)
    if not n or total[-1] < min_words:
        return []
    forward = np.searchsorted(total, total[:-1] + min_words, side="left")  # behind the last line, from each first
    backward = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # the first line, from each last
    spans = {(i, int(e)) for i, e in enumerate(forward) if e <= n}
    spans |= {(int(b), i + 1) for i, b in enumerate(backward) if b >= 0}
    data = [x.encode() for _, x in kept]
    hashes = [xxhash.xxh3_64_intdigest(x) for x in data]
    selected: dict[int, dict[tuple[bytes, int, int], None]] = {}
    for a, e in spans:
        digest = xxhash.xxh3_128(b"\n".join(data[a:e])).digest()
        low = min(range(a, e), key=lambda i: (hashes[i], i))
        selected.setdefault(low, {})[digest, kept[a][0], kept[e - 1][0] + 1] = None
    return [((hashes[i] & (2**63 - 1)), list(found)) for i, found in selected.items()]


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """By (doc_id, text_hash) the spans of lines to delete, merged; documents without any are left out."""
    kept = docs.select("doc_id", common.text_hash(F.col("text")).alias("text_hash"), "text").where("text is not null")
    doc_type = kept.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("digest", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            at, prints, spans = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for fingerprint, found in windows(text, min_words):
                    at.append(i)
                    prints.append(fingerprint)
                    spans.append([{"digest": d, "start": a, "stop": e} for d, a, e in found])
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(prints, pa.int64()), pa.array(spans, pa.list_(span))], ["doc_id", "text_hash", "fingerprint", "windows"]
            )

    prints = kept.mapInArrow(rows, f"doc_id {doc_type}, text_hash long, fingerprint long, windows array<struct<digest:binary,start:int,stop:int>>")
    prints = common.stored(prints, "fingerprints")
    repeated = prints.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    around = prints.join(repeated, "fingerprint").select(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", F.explode("windows").alias("w"),
    ).select("no_id", "doc_id", "text_hash", "w.digest", "w.start", "w.stop")
    around = common.stored(around, "windows")
    first = around.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("no_id", "doc_id", "text_hash", "start", "stop")).alias("f")).where("n > 1")
    same_doc = F.col("f.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f.text_hash") == F.col("text_hash"))
    later = around.join(first, "digest").where(~(same_doc & (F.col("start") < F.col("f.stop"))))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text cut, and a struct column ``removed`` (n_lines, n_removed, spans) under a free name, last."""
    runs = repeated_runs(docs, min_words).alias("r")
    whole = docs.select(F.struct(*[common.col(docs, c) for c in docs.columns]).alias("row"), F.col("doc_id"), common.text_hash(F.col("text")).alias("text_hash"), F.col("text")).alias("d")
    joined = whole.join(runs, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.text_hash") == F.col("r.text_hash")), "left").select("d.row", "d.text", "r.spans")

    @F.pandas_udf("text string, n_lines long, n_removed long, spans array<struct<start:int,stop:int>>")
    def cut(texts, spans):
        import pandas as pd

        out = [_cut(t, [(s["start"], s["stop"]) for s in x]) for t, x in zip(texts, spans)]
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "spans"])

    # Only rows with something to delete go through Python.
    hit = joined.where("spans is not null").select("row", cut("text", "spans").alias("c"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rest = joined.where("spans is null").select("row", F.struct("text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")).alias("c"))
    out = hit.unionByName(rest)
    columns = [F.col("c.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, F.struct("c.n_lines", "c.n_removed", "c.spans").alias(common.fresh(docs, "removed")))


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int, list[dict[str, int]]]:
    lines = text.split("\n")
    edge = np.zeros(len(lines) + 1, np.int64)
    for a, e in spans:
        edge[a] += 1
        edge[e] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    merged = [{"start": int(a), "stop": int(e)} for a, e in bounds.reshape(-1, 2)]
    return "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), int(gone.sum()), merged
