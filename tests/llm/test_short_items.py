import corpus_pipeline
from scrubwell.llm.decontaminate import clean


def test_stage_finds_short_items_in_longer_texts(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, "Red blue green"), (2, "x"), (3, None), (4, "one two three four five six")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["a b c red BLUE green d", "a b red c blue green d", "xx y z w v u", "a b c d e x", "red blue green", "red blue", None, ""]
    left = corpus_pipeline.decontamination(spark, docs(texts), str(tmp_path)).collect()
    assert {x.doc_id for x in left} == {1, 2, 5, 6, 7}
    assert {x.doc_id for x in clean(docs(texts), items).collect()} == {1, 2, 5, 6, 7}
