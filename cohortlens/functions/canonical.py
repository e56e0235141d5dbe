"""Canonical JSON of any column, and digests of whole tables that don't depend on how their rows are dealt.

A serialiser is made from a column's type: names of fields and keys of maps in their order by code points, no white space, all but
printable ASCII escaped, and floating-point numbers in their shortest form. It gives the bytes that Python's ``json.dumps`` gives with
``ensure_ascii``, ``sort_keys`` and compact separators. Everything is built in but the shortest form of doubles, an Arrow UDF.

A table's digest is a tree over its rows' hashes: a row of equal hashes keeps their number, rows are put together by so many leading hex
digits that about ``BUCKET`` fall to each, and groups by one digit less until one is left. Hashes are spread evenly, so a group is
bounded whatever the rows are, and a third of all rows alike are one row with a count.

Defined results: null is ``null``; NaN and infinite numbers are an error; types that JSON lacks (dates, decimals, binary) are refused when the
serialiser is made; an empty table's digest is that of no rows.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

from cohortlens.operators.staging import stored

BUCKET = 256
#: Escapes that have a letter of their own.
_SHORT = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r", 34: '"', 92: "\\"}


@F.pandas_udf(StringType())
def shortest(c: pd.Series) -> pd.Series:
    """The shortest decimal form that reads back as the number."""
    return c.map(lambda x: None if pd.isna(x) else repr(float(x)))


def _hex4(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))


def escaped(c: Column) -> Column:
    """A text as a JSON string."""

    def one(ch: Column) -> Column:
        n = F.ascii(ch)
        wide = n - 0x10000
        found = F.when((n >= 32) & (n <= 126) & ~n.isin(34, 92), ch)
        for code, letter in _SHORT.items():
            found = found.when(n == code, F.lit("\\" + letter))
        return found.when(n < 0x10000, _hex4(n.cast("long"))).otherwise(F.concat(_hex4(F.lit(0xD800) + F.shiftright(wide, 10)), _hex4(F.lit(0xDC00) + wide.bitwiseAND(F.lit(0x3FF)))))

    plain = ~c.rlike(r'[^ !#-\[\]-~]')
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(F.split(c, ""), one), "")), F.lit('"'))


def _floats(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _floats(kind.elementType)
    if isinstance(kind, MapType):
        return _floats(kind.valueType)
    return any(_floats(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else isinstance(kind, (DoubleType, FloatType))


def canonical(c: Column, kind: DataType) -> Column:
    """The canonical JSON of a column of this type. Doubles may stand in structs, not below arrays or maps, where no UDF reaches."""
    if isinstance(kind, NullType):
        return F.lit("null")
    if isinstance(kind, StringType):
        found = escaped(c)
    elif isinstance(kind, (IntegralType, BooleanType)):
        found = c.cast("string")
    elif isinstance(kind, (DoubleType, FloatType)):
        odd = F.isnan(c) | c.isin(float("inf"), float("-inf"))
        found = F.when(odd, F.raise_error(F.lit("canonical JSON has no NaN and no infinite number"))).otherwise(shortest(c))
    elif isinstance(kind, ArrayType) and not _floats(kind):
        found = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType) and not _floats(kind):
        entries = F.array_sort(F.map_keys(c))
        found = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda k: F.concat(escaped(k), F.lit(":"), canonical(F.element_at(c, k), kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, StructType):
        fields = [F.concat(escaped(F.lit(f.name)), F.lit(":"), canonical(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        found = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    else:
        raise TypeError(f"canonical JSON has no {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(found)


def canonical_rows(df: DataFrame) -> Column:
    """The canonical JSON of each row of ``df``."""
    fields = [F.concat(escaped(F.lit(f.name)), F.lit(":"), canonical(df[f"`{f.name}`"], f.dataType)) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def table_digest(df: DataFrame, bucket: int = BUCKET) -> str:
    """A digest of the rows as a multiset."""
    rows = df.select(F.sha2(canonical_rows(df), 256).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    level = stored(rows.select("node", F.concat("node", F.lit("*"), F.col("times").cast("string")).alias("part")), "digest")
    n, depth = level.count(), 0
    while n > bucket * 16**depth:
        depth += 1
    for digits in range(depth, -1, -1):
        group = F.substring("node", 1, digits) if digits else F.lit("")
        level = level.groupBy(group.alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ","), 256).alias("digest")).select("node", F.concat("node", F.lit(":"), "digest").alias("part"))
    found = level.first()
    return found["part"][1:] if found else hashlib.sha256(b"").hexdigest()


def population_problems(ids: DataFrame, key: str) -> DataFrame:
    """``(problem, value)``: blank identifiers, and those that come twice; no rows where a population may be bound."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    twice = ids.where(~blank).groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), "value")
    return ids.where(blank).select(F.lit("blank").alias("problem"), F.col(key).alias("value")).unionByName(twice)


def population_digest(ids: DataFrame, key: str, event_key: str) -> str:
    """What binds an event to the set of its applicants without naming them: a table digest, so that no task sees all of them."""
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{1,127}", event_key):
        raise ValueError(f"not an event key: {event_key}")
    return table_digest(ids.select(F.col(key).alias("application_id"), F.lit(event_key).alias("event_key")))
