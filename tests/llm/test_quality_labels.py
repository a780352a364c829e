"""Operator 5: labelled ids without a document take no place of those with one."""

from lexiquarry.llm import quality


def test_labels_without_documents_use_no_places(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(3000)], "doc_id bigint, quality int, toxic int")
    rows = quality.sample(docs, labels, per_class=5).toPandas()
    assert rows["class"].value_counts().to_dict() == {0: 5, 1: 5, 2: 5}
