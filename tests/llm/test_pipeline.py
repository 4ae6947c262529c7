import corpus_pipeline
from conftest import DATA

from weftline.llm import decontaminate, minhash, secrets


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.saved(stage(spark, docs, DATA), name)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
        if name == "near_duplicates":
            assert minhash.near_duplicates(docs).filter("component_id <> doc_id").count() == 0
        if name == "decontamination":
            assert decontaminate.leaks(docs, bench).count() == 0
        if name == "secrets":
            assert counts[-1] == counts[-2] and secrets.scan(docs).filter("size(__spans) > 0").count() == 0
    assert before >= counts[0] > counts[1] > counts[2] == counts[3] >= counts[4] > 0.5 * before
    assert docs.filter("copies < 1 or taken > 2 * size").count() == 0


def test_stages_bear_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, columns with clashing names, and tables without rows."""
    from pyspark.sql import functions as F

    columns = "doc_id long, text string, lang string, source string, n_chars long, label int, __id string, target double, node string, size string"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1, 7, "x", 0.5, "n", "s"), (1, text, "en", "a", 1, 7, "x", 0.5, "n", "s"), (None, None, None, None, None, None, None, None, None, None), (2, "", "en", None, 0, 7, "y", 0.5, "n", "s"), (3, "token = abcdefgh12", "en", "b", 9, 7, "z", 0.5, "n", "s"), (4, text + " more", "en", "b", 9, 7, "z", 0.5, "n", "s")]
    spark.createDataFrame([(1, 0, 1), (None, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given, want in ((rows, [6, 5, 5, 5]), ([], [0, 0, 0, 0])):
        docs = spark.createDataFrame(given, columns)
        for (name, stage), n in zip(corpus_pipeline.STAGES, want):
            docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), name)
            assert docs.count() == n and (docs.columns == [c.split()[0] for c in columns.split(", ")]), name
        mixed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
        assert mixed.count() <= 5 and mixed.filter(F.col("taken") > 2 * F.col("size")).count() == 0
