"""The payload walk against a plain recursive one."""

import json
import random

from cohortlens.functions import redaction
from cohortlens.operators import payloads
from pyspark.sql import functions as F


def plain(payload, allowed=()):
    try:
        value = json.loads(payload)
    except (TypeError, ValueError):
        return "root", "unparsable"
    chars = 0

    def visit(x, name, depth, path):
        nonlocal chars
        chars += len(name or "")
        parts = "".join(c if c.isascii() and c.isalnum() else " " for c in (name or "").lower()).split()
        if name is not None and name not in allowed and any(p.startswith(f) for p in parts for f in payloads.FORBIDDEN):
            return path, "forbidden_field"
        if depth > 8:
            return path, "too_deep"
        if isinstance(x, dict):
            if len(x) > 100:
                return path, "too_many_fields"
            below = [visit(x[k], k, depth + 1, f"{path}.{k}") for k in sorted(x)]
        elif isinstance(x, list):
            if len(x) > 100:
                return path, "too_many_items"
            below = [visit(v, None, depth + 1, f"{path}[{i}]") for i, v in enumerate(x)]
        else:
            chars += len(x) if isinstance(x, str) else 0
            label = redaction.marker(x) if isinstance(x, str) else None
            return (path, label) if label else None
        return next(filter(None, below), None)

    found = visit(value, None, 0, "root")
    return found or (("root", "too_long") if chars > 12_000 else (None, None))


def some(rng, depth=0):
    kind = rng.random()
    if depth > 10 or kind < 0.3:
        return rng.choice([None, True, 1, 2.5, "built tools", "", "x@y.org", "Ann built it", "é 😀", "evidence is limited."])
    if kind < 0.65:
        return {rng.choice(["a", "b", "kind", "user_name", "my-email", "emails", "e mail", "topic_codes", "é", "Z"]): some(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [some(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def test_walk(spark):
    rng = random.Random(1)
    rows = [json.dumps(some(rng), ensure_ascii=rng.random() < 0.5) for _ in range(250)]
    rows += [None, "", "nope", "{", "null", '"text"', json.dumps({str(i): 1 for i in range(101)}), json.dumps(list(range(101))), json.dumps(list(range(100))), json.dumps({"t": "x" * 12_001}), "[" * 9 + "]" * 9, "[" * 10 + "]" * 10, "[" * 200 + "]" * 200]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, p string").repartition(3)
    for allowed in ((), ("user_name", "emails")):
        found = payloads.first_problems(payloads.nodes(df, "i", "p"), redaction.marker_of, allowed)
        got = {r["key"]: (r["path"], r["problem"]) for r in found.collect()}
        assert got == {i: plain(p, allowed) for i, p in enumerate(rows)}
    assert payloads.first_problems(payloads.nodes(df.limit(0), "i", "p"), redaction.marker_of).count() == 0


def test_a_name_twice(spark):
    df = spark.createDataFrame([(1, '{"a":1,"a":2}')], "i int, p string")
    assert payloads.first_problems(payloads.nodes(df, "i", "p"), lambda t: F.lit(None).cast("string")).first()["problem"] == "unparsable"


def test_payloads_of_a_small_table_are_made_by_all_cores(spark, sf):
    """A table of one split gives payloads hundreds of times as long, which one task made and parsed."""
    from cohortlens.plans import queries, review_queries  # in this order

    assert "payload_literals" in queries.QUERIES and len(review_queries._walk(spark, sf).where("depth = 0").select(F.input_file_name()).distinct().collect()) > 1
