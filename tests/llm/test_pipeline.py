import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_run_on_awkward_rows(spark, tmp_path):
    from tests.llm.test_operators import SCHEMA, prose, texts

    rows = [(d, t, "en", ["a", "b", None][i % 3], None, 1, 2, "x", "g", "p", "s") for i, (d, t) in enumerate(texts())]
    junk = [(9000 + i, "BUY NOW!! " * (5 + i % 20), "en", "a", None, 1, 2, "x", "g", "p", "s") for i in range(40)]
    spark.createDataFrame(rows + junk, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(d, 1) for d, t in texts() if t and 10 <= d < 50] + [(9000 + i, 0) for i in range(40)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(9, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/stage{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage{k}")
            counts.append(docs.count())
    ids = {r["doc_id"] for r in docs.collect()}
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2]
    assert not ids & {9000 + i for i in range(40)} and 19 not in ids
    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_empty_table(spark, tmp_path):
    from tests.llm.test_operators import SCHEMA

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
