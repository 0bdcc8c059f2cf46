import re

import corpus_pipeline
from sparkfold.llm import common

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA))
        if name != "packing":
            assert docs.columns == columns
            assert 0 < docs.count() <= before
            before = docs.count()
        seen.append(docs)
    passages = [r.text for r in seen[3].select("text").collect()]
    windows = [t.encode()[k : k + 100] for t in passages for k in range(len(t.encode()) - 99)]
    assert len(windows) - len(set(windows)) < 0.01 * len(windows)  # a cut can bring together what was apart
    texts = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (WORD.findall(r.text.lower()) for r in seen[2].select("text").collect())]
    for a in range(len(texts)):
        for b in range(a):
            assert 100 * len(texts[a] & texts[b]) < 80 * len(texts[a] | texts[b])


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_stages_of_odd_rows(spark, docs, rows, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, and columns with the names that operators use; then the empty table."""
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, k % 2, k % 3 == 0) for k, (i, t) in enumerate(rows)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.withColumn("_d", F.lit(1)).withColumn("_row", F.lit("r")).withColumn("_copy", F.lit(None).cast("string")).withColumn("_spans", F.lit(2))
    whole = {(r.doc_id, r.text) for r in odd.collect()}
    for table in (odd, odd.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.stored(stage(spark, now, str(tmp_path)))
            assert now.columns == odd.columns
            if name != "suffix-array dedup":
                assert {(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()} <= whole
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        tokens = {r.doc_id for r in now.select("doc_id").collect()}
        assert {r.doc_id for r in last.collect()} == tokens
