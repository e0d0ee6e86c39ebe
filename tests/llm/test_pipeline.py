"""The pipeline's stages, each judged on its own input."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from bytewren.llm import queries, simhash, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        before_ids, after_ids = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert after_ids <= before_ids
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert after_ids == {r.doc_id for r in docs.collect() if model.score((r.text or "").encode()) < 0.5}
        if name == "simhash_near_dedup":
            assert after_ids == {r.component for r in simhash.near_duplicates(docs).collect()}
        if name == "secret_scan":
            assert after_ids == before_ids
        if name == "byte_bpe":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert after.count() == docs.count()
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in after.collect())
        docs = after


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    key = got.columns[0]
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    for column in got.columns:
        assert (got[column] == want[column]).all(), column


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    table = "embeddings" if name.startswith("op5_") else "documents"
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    found = queries.QUERIES[name](spark, DATA)
    assert found.count() == rows == found.select(found.columns[0]).distinct().count()
