"""The pipeline on whole tables, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import components_by_hand
from assetlens.llm import decontam, langid, oracle, queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and 0 < after.count() <= before.count()
            assert after.join(docs, docs.columns, "left_anti").count() == 0
            before = after
    assert after.count() == before.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.decontaminate(before, bench).filter("contaminated").count() == 0
    assert before.filter("text is null").count() == 0
    assert langid.UNKNOWN == "und"


def test_run(spark, sf_dir):
    import glob

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/assetlens/stage-*"))
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    left = set(glob.glob(f"{shared}/assetlens/stage-*")) - before
    assert len(left) == 1 and "stage-4" in left.pop()


def test_near_copies_by_hand(spark, sf_dir):
    """Of each group of linked documents, the one of least doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {i for i, _, root in components_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()]) if i == root}


def test_stages_on_odd_tables(spark, sf_dir):
    """Null, empty, repeated and very long texts, empty tables and further columns of clashing names."""
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'").first()["text"]
    rows = [(1, None, None, None), (2, "", "en", None), (3, "7 7", "fr", "s"), (4, text, "en", "s"), (4, text, "en", "s"), (5, text, None, "t"), (6, (text + " ") * 500, "en", "t"), (None, text, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(docs.columns).filter("doc_id > 20"))
    for c in ("score", "n_tokens", "component_id", "n_hit", "sampled", "start"):
        docs = docs.withColumn(c, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and stage(spark, docs.filter("false"), sf_dir).count() == 0
    kept = sorted((r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=str)
    known = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    roots = {i for i, _, root in components_by_hand([x for x in known if x[0] is not None]) if i == root}
    assert kept == sorted((i for i, _ in known if i is None or i in roots), key=str) and kept.count(4) == 2 and 5 not in kept
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, sf_dir).filter("doc_id < 10").collect()} == {4, 5, 6}
    assert corpus_pipeline.token_binary(spark, docs, sf_dir).count() == docs.count()
    assert corpus_pipeline.token_binary(spark, docs.filter("false"), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    told = db.sql(oracle.SQL[name])
    cols = sorted(found.columns)
    assert cols == sorted(told.columns)
    want = sorted(tuple(map(str, r)) for r in told.project(", ".join(cols)).fetchall())
    assert sorted(tuple(map(str, r)) for r in found.select(cols).collect()) == want
