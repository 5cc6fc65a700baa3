import corpus_pipeline
from readloom.llm import minhash, queries, toxicity


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in toxicity.score(docs, model).where("score < 0.5").select("doc_id").collect())
        elif k == 1:
            assert out.count() == docs.count()
        elif k == 2:
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted({r["class_id"] for r in minhash.near_duplicates(docs).collect()})
        elif k == 4:
            assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
        docs = out.cache()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_odd_rows_and_empty_tables(spark, odd, sf):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, sf).cache()
        corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
