"""A walk over JSON payloads, level by level: what a payload holds that it must not, and where.

A payload is parsed once into a VARIANT; each level of the walk opens the containers of the level above with ``variant_explode``
and is written to the shared folder, so that no level is computed twice. Payloads are rows, so a third of all payloads with
the same content are as many rows and no group.

Order: a payload's first problem is the one of the least path, where an object's fields are in the order of their names and items in
their own; at one path the order is ``forbidden_field``, ``too_deep``, ``too_many_fields`` or ``too_many_items``, then the marker of
a text. ``too_long`` (names and texts together) comes last, as it is no single place's.

Defined results: null and blank payloads, and what is no JSON, are ``unparsable``; an object that has a name twice is, too; an empty table gives
no rows. The keys of ``allowed`` may be used however they read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.staging import new_path, stored

MOST_DEPTH, MOST_ENTRIES, MOST_CHARS = 8, 100, 12_000
# A field is forbidden if a part of its name begins with one of these.
FORBIDDEN = "activity contact email handle identifier linkedin login name owner phone post profile recommendation source telephone uri url username".split()


def forbidden_key(key: Column) -> Column:
    """Whether a part of the name, between anything but letters and digits, begins with a forbidden word."""
    return F.lower(key).rlike(rf"(^|[^a-z0-9])({'|'.join(FORBIDDEN)})")


def nodes(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """A row for each value: key, depth, name, place (for the order), path, kind, text, entries, parsed.

    ``entries`` counts a container's; values below the greatest depth are not opened. ``kind`` is the JSON type's name.
    """
    spark, base = payloads.sparkSession, new_path(payloads.sparkSession, "payloads")
    root = payloads.select(F.col(key).alias("key"), F.try_parse_json(F.col(payload)).alias("v"))
    level = root.select("key", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("place"), F.lit("root").alias("path"), "v")
    depth = 0
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        level = level.withColumn("kind", F.when(F.col("v").isNull(), "NONE").otherwise(kind))
        level = level.withColumn("text", F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string")))
        size = F.when(F.col("kind") == "OBJECT", F.size(F.try_variant_get("v", "$", "map<string,variant>"))).when(F.col("kind") == "ARRAY", F.size(F.try_variant_get("v", "$", "array<variant>")))
        level = stored(level.withColumn("entries", size), "payloads", f"{base}/depth={depth}")
        open_ = level.where("entries > 0")
        if depth > MOST_DEPTH or open_.isEmpty():
            return spark.read.schema(level.drop("v").schema).parquet(f"{base}/depth=*")
        level = _opened(open_)
        depth += 1


def _opened(level: DataFrame) -> DataFrame:
    """The entries of containers: names of fields and numbers of items make place and path."""
    level.createOrReplaceTempView("_payload_level")
    rows = level.sparkSession.sql("SELECT l.key AS key, l.depth + 1 AS depth, e.key AS name, l.place AS place, l.path AS path, e.pos AS pos, e.value AS v FROM _payload_level l, LATERAL variant_explode(l.v) e")
    level.sparkSession.catalog.dropTempView("_payload_level")
    item = F.col("name").isNull()
    step = F.when(item, F.lpad(F.col("pos").cast("string"), 10, "0")).otherwise(F.col("name"))
    path = F.concat("path", F.when(item, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("name"))))
    return rows.select("key", "depth", "name", F.concat("place", F.array(step)).alias("place"), path.alias("path"), "v")


def first_problems(walk: DataFrame, marker: Callable[[Column], Column], allowed: Iterable[str] = (), most_chars: int = MOST_CHARS) -> DataFrame:
    """``(key, path, problem)`` of the first problem of each payload; both null where there is none."""
    ok = F.col("name").isin(*allowed) if (allowed := list(allowed)) else F.lit(False)
    many = F.col("entries") > MOST_ENTRIES
    problem = (
        F.when(F.col("kind") == "NONE", "unparsable").when(F.col("name").isNotNull() & ~ok & forbidden_key(F.col("name")), "forbidden_field").when(F.col("depth") > MOST_DEPTH, "too_deep")
        .when(many & (F.col("kind") == "OBJECT"), "too_many_fields").when(many, "too_many_items").otherwise(F.col("marker"))
    )
    seen = walk.withColumn("marker", F.when(F.col("text").isNotNull(), marker(F.col("text")))).withColumn("problem", problem)
    chars = F.coalesce(F.length("name"), F.lit(0)) + F.coalesce(F.length("text"), F.lit(0))
    found = seen.groupBy("key").agg(F.min(F.when(F.col("problem").isNotNull(), F.struct("place", "path", "problem"))).alias("f"), F.sum(chars).alias("chars"))
    long = F.col("f").isNull() & (F.col("chars") > most_chars)
    return found.select("key", F.when(long, "root").otherwise(F.col("f.path")).alias("path"), F.when(long, "too_long").otherwise(F.col("f.problem")).alias("problem"))
