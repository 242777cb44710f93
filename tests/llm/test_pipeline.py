"""The registered queries of the subpackage and the pipeline, stage by stage."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from larder.llm import decontaminate, pii, queries, simhash
from larder.session import materialise

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())


def test_all_registered():
    found = contract.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, docs, FOLDER))
        assert after.columns == columns
        ids, kept = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in after.select("doc_id").collect()}
        assert kept <= ids
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
            assert len(kept) == groups
        if name == "benchmark_decontamination":
            bad = decontaminate.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).filter("contaminated")
            assert ids - kept == {r["doc_id"] for r in bad.collect()}
        if name == "pii":
            assert kept == ids
            left = pii.report(after.select("doc_id", "text")).agg({"n_email": "sum", "n_ip": "sum", "n_phone": "sum"}).first()
            assert not any(left)
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
