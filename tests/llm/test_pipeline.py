from __future__ import annotations

import corpus_pipeline
from lawloom.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.materialise(docs)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and now and (name == "PII") <= (now == before)
        before = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == before
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in ran) == sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces)


def test_each_stage_on_odd_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "x", "en", "s", 1)], empty.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name
        assert {r.doc_id for r in stage(spark, odd, SF).collect()} == {10**9, 10**9 + 1, 10**9 + 2}, name


def test_stages_on_repeated_rows_and_clashing_columns(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 12").unionByName(spark.createDataFrame([(10**9, "Mail me: a.b@c.example", None, None, 1)], spark.read.parquet(f"{SF}/documents.parquet").schema))
    names = ["score", "class_id", "n_links", "item_id", "similarity", "finds", "terms", "row", "text_key", "high", "cluster"]
    docs = some.selectExpr("*", *(f"concat('{n}', doc_id) AS {n}" for n in names))
    docs = docs.unionByName(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        ids = [r.doc_id for r in rows]
        assert all(ids.count(i) == 2 for i in ids) and 10**9 in ids, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(p.doc_id for p in pieces if p.piece == 0) == sorted(r.doc_id for r in docs.collect())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in __import__("__spark_entry__").queries()
