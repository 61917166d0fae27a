import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from shardloom.llm import near_dups, quality
from shardloom.llm.common import written


def test_stages_on_awkward_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "s", None), (900002, "", None, None, 0), (None, "Without an id but long enough to be a text of its own.", "en", "s", 5)], docs.schema)
    doubled = docs.unionByName(extra).unionByName(docs.limit(3)).withColumn("score", F.lit("clash"))
    for docs_in in (doubled, doubled.limit(0)):
        now = docs_in
        for name, stage in pipeline.STAGES:
            columns = now.columns
            now = written(stage(spark, now, sf))
            if name != "packing":
                assert now.columns == columns
    assert "sequence_id" in now.columns


def test_each_stage_does_what_its_operator_says(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = [written(f(spark, docs, sf)) for _, f in pipeline.STAGES[:4]]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    model = quality.fit(docs, labels)
    assert ids(kept[0]) == ids(quality.score(docs, model).where("predicted = 1"))
    assert ids(kept[1]) == ids(near_dups.near_duplicates(docs).where("kept"))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in kept[2].collect()}
    assert not [t for t in left.values() if any(i in t for i in items)] and len(left) > 0.9 * docs.count()
    assert ids(kept[3]) == ids(docs)
    assert not [r for r in kept[3].collect() if re.search(r"[0-9a-f]{32}|token\s*=\s*\"[0-9a-f]{8}", r.text)]
    assert all(r.n_chars == len(r.text) for r in kept[3].collect())


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.count() > 0 and pipeline.ORACLE_SQL is None
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_items_in_capitals_are_dropped(spark, sf):
    item = next(r for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if sum(w.istitle() for w in r.text.split()) > 2)
    docs = spark.createDataFrame([(1, item.text.upper()), (2, "a clean text of a few words")], "doc_id long, text string")
    assert [r.doc_id for r in pipeline.drop_contaminated(spark, docs, sf).collect()] == [2]
