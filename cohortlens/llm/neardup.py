"""Operator 9: near-duplicates by banded MinHash, odd sketches and an exact check.

1. A document's set is its distinct word shingles, as 64-bit hashes. MinHash samples make bands (candidates) and
   are folded into a parity bitmap, the odd sketch: bit ``h(i, sample_i)`` is flipped for each sample, so the
   population count of two bitmaps' XOR tells how many samples differ, precisely where similarity is high.
2. Documents with equal sets collapse to a class; thousands of copies are one row from here on.
3. Each band's bucket has a centre, the member that a hash of the bucket's own chooses. The odd sketch drops pairs of a
   member and a centre that are clearly too far. First only the nearest centre of each member is confirmed on full
   sets, and components are formed; a group of copies is nearly one component after that, whatever its size.
4. Members of buckets that hold several components get a finer odd sketch. Their other centres are compared, where
   the component differs, and components are formed again. Then all pairs between components in a bucket are (the sketch
   test is part of the join, so only near pairs are made, each in its first common bucket alone). So no pair that
   shares a bucket is left out but where both are in one component already.
5. Components by large-star and small-star; the smallest doc_id names one.

With 32 bands of 4 samples a pair of similarity 0.85 shares no bucket with probability 6e-11 (at 0.8: 5e-8); the
sketch's threshold is four and a half standard deviations beyond the similarity asked for.

Defined results: null text has no words; a document without words has an empty set and links with nothing; one
with fewer words than a shingle has its whole sequence as its only shingle. Rows that agree in doc_id and text are
one document and get equal rows; where rows share a doc_id but not the text each is linked by its own text; rows
with a null doc_id take part, and a component is named by its smallest doc_id that isn't null. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common
from cohortlens.llm.components import components

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 256
_random = np.random.default_rng(9)
A = _random.integers(1, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
B = _random.integers(0, 1 << 63, SAMPLES, np.uint64)
#: Samples and bits of the finer sketch, made only for members of buckets that stay in more than one component.
FINE_SAMPLES, FINE_BITS = 4096, 4096
FINE_A = _random.integers(1, 1 << 63, FINE_SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
FINE_B = _random.integers(0, 1 << 63, FINE_SAMPLES, np.uint64)
MIX = _random.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
CACHE_WORDS = 250_000
#: Text hashes (8 bytes each) that are sent to all executors at most.
WANTED_ROWS = 500_000
#: Standard deviations that the sketch's threshold leaves: one true pair in 300,000 at the very threshold is missed.
MARGIN = 4.5


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    # bytes.lower() changes A-Z alone and bytes.split() cuts at space and \t to \r, on UTF-8 as on code points.
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens))], np.uint64)
    hashes = common.held("shingles", _Hashes)
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - words + 1
    total = h[:n] * MIX[0]
    for i in range(1, words):
        total += h[i:i + n] * MIX[i]
    return np.unique(_mixed(total))


def samples(s: np.ndarray, a: np.ndarray = A, b: np.ndarray = B) -> np.ndarray:
    low = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(s), 1024):
        x = a[:, None] * s[None, at:at + 1024]
        x += b[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low


def odd_sketch(low: np.ndarray, b: np.ndarray = B, bits: int = BITS) -> np.ndarray:
    """The parity of the samples' places, as signed 64-bit numbers."""
    place = _mixed(low + b) % np.uint64(bits)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def farthest(similarity: float, n_samples: int = SAMPLES, bits: int = BITS, part: bool = False) -> int:
    """The largest XOR population count that a pair of this similarity has, MARGIN standard deviations above the mean.

    ``part``: of so many bits of a longer sketch, in which so many samples are expected.
    """
    differ = n_samples * (1 - similarity)
    left = math.exp(-4 * differ / bits)
    odd = (1 - left) / 2
    # What the number of differing samples varies by, and what places that coincide do.
    sampled, coinciding = 4 * left**2 * differ * similarity, bits * odd * (1 - odd) - (0 if part else left**2 * 2 * differ)
    return math.ceil(bits * odd + MARGIN * math.sqrt(sampled + coinciding))


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """Per row doc_id, text_hash, n_shingles, cls (digest of the set), bands and sketch."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kept = docs.select("doc_id", common.text_hash(F.col("text")).alias("text_hash"), text.alias("text"))
    doc_type = kept.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 8 << 20):
            n, cls, bands, sketch = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                if not len(s):
                    bands.append([])
                    sketch.append([])
                    continue
                low = samples(s)
                band = _mixed((low.reshape(BANDS, ROWS) * MIX[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
                bands.append(band.view(np.int64))
                sketch.append(odd_sketch(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "cls", "bands", "sketch"],
            )

    return kept.mapInArrow(rows, f"doc_id {doc_type}, text_hash long, n_shingles long, cls binary, bands array<long>, sketch array<long>")


def _sizes(similarity: float) -> Column:
    return F.least("nu", "nv") >= F.greatest("nu", "nv") * F.lit(similarity - 1e-9)


def _apart(sketch: str, longs: int) -> Column:
    """The population count of the XOR of two sketches' first words."""
    u, v = F.col(f"{sketch}u"), F.col(f"{sketch}v")
    return sum((F.bit_count(u[i].bitwiseXOR(v[i])) for i in range(1, longs)), F.bit_count(u[0].bitwiseXOR(v[0])))


def _near(similarity: float) -> Column:
    """Whether the finer sketches leave it possible that two sets are as similar as that; an eighth of them first."""
    part = _apart("fine", FINE_BITS // 512) <= farthest(similarity, FINE_SAMPLES // 8, FINE_BITS // 8, part=True)
    # As a sum of all words the condition would be too long a method for the JIT compiler.
    whole = F.aggregate(F.zip_with("fineu", "finev", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return part & (whole <= farthest(similarity, FINE_SAMPLES, FINE_BITS))


def _nearest(pairs: DataFrame, name: str) -> DataFrame:
    """Of pairs (u, v, tu, tv, apart) the nearest of each v."""
    found = pairs.groupBy("v").agg(F.min(F.struct("apart", F.xxhash64("u", "v").alias("h"), "u", "tu", "tv")).alias("m"))
    return common.stored(found.select("m.u", "v", "m.tu", "m.tv"), name)


def _mixed_buckets(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``members`` (bucket, cls) with their components, of the buckets that hold several."""
    labels = labels.withColumnsRenamed({"node": "cls"})
    placed = common.stored(members.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return common.stored(placed.join(mixed, "bucket", "left_semi"), name)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of earlier ones and new links."""
    return components(labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(t, text)`` of the wanted text hashes ``t``, each once."""
    wanted = common.stored(wanted.distinct(), "wanted")
    # So few hashes spare all texts the shuffle; with more, texts and hashes are shuffled.
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED_ROWS else wanted
    texts = docs.select(common.text_hash(F.col("text")).alias("t"), F.col("text").cast("binary").alias("text"))
    return common.stored(texts.join(wanted, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text")), "texts")


def fine_sketches(texts: DataFrame, words: int) -> DataFrame:
    """``(t, fine)``: the finer odd sketch of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 8 << 20):
            fine = [odd_sketch(samples(shingles(t.as_py(), words), FINE_A, FINE_B), FINE_B, FINE_BITS) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(fine, pa.list_(pa.int64()))], ["t", "fine"])

    return texts.mapInArrow(rows, "t long, fine array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs ``(u, v)`` with the text hashes ``tu`` and ``tv``, those whose full sets are similar enough.

    A text goes to each pair's row, not pairs to a text's task: a centre of many pairs is a skewed join, which
    Spark splits.
    """
    texts = _texts(docs, pairs.select(F.col("tu").alias("t")).unionByName(pairs.select(F.col("tv").alias("t"))))
    first, second = texts.select(F.col("t").alias("tu"), F.col("text").alias("a")), texts.select(F.col("t").alias("tv"), F.col("text").alias("b"))
    both = pairs.join(second, "tv").join(first, "tu").select("u", "v", "tu", "a", "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in common.slices(batches, "b", 16 << 20):
            keep = []
            for tu, x, y in zip(batch.column("tu").to_pylist(), batch.column("a"), batch.column("b")):
                if tu != last:
                    last, a = tu, shingles(x.as_py(), words)
                b = shingles(y.as_py(), words)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(rows, "u binary, v binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept, and ``group``: null for empty sets."""
    similarity = percent / 100
    sketches = common.stored(sketched(docs, words), "sketches")
    classes = sketches.where("n_shingles > 0").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("t"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    classes = common.stored(classes, "classes")
    members = classes.select("cls", F.explode("bands").alias("bucket"))
    # A bucket's centre is its smallest member by a hash of its own, so a pair meets other centres in other bands.
    centres = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("cls", "bucket"), "cls")).alias("c"))
    centres = centres.where("size > 1").select("bucket", F.col("c.cls").alias("centre"))
    buckets = common.stored(members.join(centres, "bucket"), "buckets")
    side = lambda df, k: df.select(*[F.col(c).alias(k if c == "cls" else c + k) for c in df.columns])

    about = classes.select("cls", "t", "n", "sketch")
    stars = buckets.where("cls <> centre").select(F.col("centre").alias("u"), F.col("cls").alias("v")).distinct()
    apart = _apart("sketch", BITS // 64)
    stars = stars.join(side(about, "v"), "v").join(side(about, "u"), "u").where(_sizes(similarity) & (apart <= farthest(similarity)))
    stars = common.stored(stars.select("u", "v", "tu", "tv", apart.alias("apart")), "stars")
    tested = _nearest(stars, "nearest")
    labels = components(confirmed(tested, docs, words, percent))

    placed = _mixed_buckets(buckets.select("bucket", "cls"), labels, "mixed")
    known = placed.groupBy("cls").agg(F.array_sort(F.collect_list("bucket")).alias("all"), F.first("component").alias("component")).join(about.drop("sketch"), "cls")
    known = common.stored(known, "known")
    fine = common.stored(known.join(fine_sketches(_texts(docs, known.select("t")), words), "t"), "fine")
    between = (F.col("componentu") < F.col("componentv")) & _sizes(similarity)
    both_ways = lambda df: df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = lambda k: fine.select(F.col("cls").alias(k), *[F.col(c).alias(c + k) for c in ("t", "n", "component", "fine")])
    others = stars.select("u", "v").join(tested, ["u", "v"], "left_anti").join(least("v"), "v").join(least("u"), "u")
    others = others.where((F.col("componentu") != F.col("componentv")) & _sizes(similarity) & _near(similarity))
    others = _nearest(others.select("u", "v", "tu", "tv", _apart("fine", FINE_BITS // 512).alias("apart")), "others")
    if not others.isEmpty():
        tested = tested.unionByName(others)
        labels = _joined(labels, confirmed(others, docs, words, percent))

    placed = _mixed_buckets(placed.select("bucket", "cls"), labels, "open").join(fine.drop("component"), "cls")
    left, right = side(placed, "u"), side(placed, "v")
    once = F.get(F.array_intersect("allu", "allv"), F.lit(0)) == F.col("bucketu")
    met = left.join(right, (F.col("bucketu") == F.col("bucketv")) & between & _near(similarity) & once)
    met = met.select("u", "v", "tu", "tv", _apart("fine", FINE_BITS // 512).alias("apart"))
    met = common.stored(met.join(both_ways(tested), ["u", "v"], "left_anti"), "met")
    if not met.isEmpty():
        # The nearest of each first: many of the other pairs are within a component then.
        first = _nearest(met, "first")
        labels = _joined(labels, confirmed(first, docs, words, percent))
        of = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"component{k}"))
        # A nearest pair that failed may be confirmed once more; that is one for each member at most.
        rest = met.join(of("u"), "u", "left").join(of("v"), "v", "left")
        rest = rest.where(F.coalesce("componentu", "u") != F.coalesce("componentv", "v")).select("u", "v", "tu", "tv")
        rest = common.stored(rest, "rest")
        if not rest.isEmpty():
            labels = _joined(labels, confirmed(rest, docs, words, percent))
    labels = labels.withColumnsRenamed({"node": "cls"})

    linked = classes.select("cls", "doc_id").join(labels, "cls")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("name"))
    named = classes.select("cls", "doc_id").join(linked.select("cls", "component").join(names, "component"), "cls", "left")
    named = named.select("cls", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("name"), F.coalesce("component", "cls").alias("group"))
    out = sketches.select("doc_id", "text_hash", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row that names it, once."""
    found = near_duplicates(docs, words, percent).where("kept")
    alone = F.encode(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_hash"), "utf-8")
    found = found.groupBy(F.coalesce("group", alone).alias("group")).agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash").alias("k")
    hash_ = common.fresh(docs, "text_hash")
    d = docs.withColumn(hash_, common.text_hash(F.col("text"))).alias("d")
    kept = d.join(found, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{hash_}") == F.col("k.text_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", hash_]).drop(hash_)
