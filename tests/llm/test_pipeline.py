import corpus_pipeline
from tidemark.llm import decontaminate, minhash, quality


def test_stages_keep_what_their_operators_keep(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "quality":
            want = [r[0] for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()]
        elif name == "near_duplicates":
            want = [r[0] for r in minhash.near_duplicates(docs).where("kept").collect()]
        elif name == "decontamination":
            want = [r[0] for r in decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated").collect()]
        else:
            want = ids(docs)
        if name == "packing":
            assert sorted({r[0] for r in out.select("doc_id").collect()}) == want
            break
        assert out.columns == columns and ids(out) == sorted(want)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
