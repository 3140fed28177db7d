import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexus.llm import decontaminate, quality, registry, simhash

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    got, want = registry.queries()[name](spark, tables), con.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    pick = lambda rows, cols: sorted((tuple(r[cols.index(n)] for n in names) for r in rows), key=repr)
    assert pick([tuple(r) for r in got.collect()], got.columns) == pick(want.fetchall(), list(want.columns))


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("labels", "benchmark"))
    out = corpus_pipeline.run(spark, tables)
    assert set(out.columns) == {*docs.columns, "shard", "slot"}
    good = {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    kept = docs.filter(F.col("doc_id").isin(sorted(good)))
    best = {r["component_id"] for r in simhash.similar_classes(kept).collect()}
    bad = {r["doc_id"] for r in decontaminate.contamination(docs, benchmark).filter("contaminated").collect()}
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == best - bad
    for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r["n"] == r["d"] == r["m"] + 1


def test_stages_on_odd_and_empty_rows(spark, tables, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, tables)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == docs.columns
            after.count()
