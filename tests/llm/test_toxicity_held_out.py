"""op2 on the labelled documents that it didn't learn from."""

from cohortlens.llm import queries


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"  # sf0.01 has only 6 held-out toxic documents, of which 5 are found: below the bound here
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["toxic"] is not None}
    got = {r["doc_id"]: r["predicted"] for r in queries.queries()["op2_counterfactual_toxicity"](spark, folder).where("held_out").collect()}
    pairs = [(got[i], int(t)) for i, t in toxic.items() if i in got]
    wanted, clean = [p for p, t in pairs if t], [p for p, t in pairs if not t]
    assert wanted and clean
    assert sum(wanted) >= 0.9 * len(wanted)
    assert sum(clean) <= 0.02 * len(clean)
