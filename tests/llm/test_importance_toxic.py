"""The resampling drops labelled toxic documents, good prose or not, and keeps good ones."""

from trackloom.llm import importance


def test_toxic_recall(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    j = importance.importance_resample(docs, labels).join(labels, "doc_id").collect()
    toxic, good = [r for r in j if r.toxic], [r for r in j if r.quality == 1 and not r.toxic]
    caught, kept = sum(not r.selected for r in toxic), sum(r.selected for r in good)
    print("toxic", len(toxic), "caught", caught, "good", len(good), "kept", kept)
    assert caught >= 0.85 * len(toxic) and kept >= 0.9 * len(good)


def test_all_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert importance.importance_resample(docs, labels).where("selected").count() == 4
