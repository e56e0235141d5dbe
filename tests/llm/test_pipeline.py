"""The pipeline's stages against brute force, each on what the one before it kept."""

import re

import corpus_pipeline
import duckdb
import pytest

from cohortlens.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows that each stage gets, then the last one's."""
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        found.append(docs)
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return [*found, docs]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(sorted(df.columns) == sorted(stages[0].columns) for df in stages[:-1])


def test_only_documents_without_a_language_go(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert {i: before[i] for i in after} == after
    assert all(not re.search(r"[^\W\d_]", before[i] or "") for i in before.keys() - after.keys())


def test_line_dedup_only_takes_lines_out(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert before.keys() == after.keys()
    for i, text in after.items():
        rest = iter((before[i] or "").split("\n"))
        assert text is None or text == "" or all(line in rest for line in text.split("\n"))


def test_one_document_of_each_group_of_near_duplicates_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])

    def shingles(text):
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in sorted(before.items())}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = sorted((group[a], group[b]), reverse=True)
                group = {i: new if g == old else g for i, g in group.items()}
    assert sorted(group[i] for i in after) == sorted(set(group.values()))


def test_contaminated_documents_go(stages, sf, tmp_path):
    stages[3].toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    hit = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.OP4_SQL}) WHERE contaminated").fetchall()}
    assert texts(stages[4]).keys() == texts(stages[3]).keys() - hit


def test_every_id_is_packed_once(stages):
    pieces = stages[5].collect()
    at, used = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == at.get(p["doc_id"], 0)
        at[p["doc_id"]] = p["start"] + p["length"]
        used[p["sequence_id"]] = used.get(p["sequence_id"], 0) + p["length"]
    assert at == {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert at.keys() == texts(stages[4]).keys() and max(used.values()) <= 2048
