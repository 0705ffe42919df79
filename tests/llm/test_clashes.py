"""Every name that operators use inside, as a column of the documents: rows come back with its values."""

import corpus_pipeline
from scrubwell.llm import pii, simhash
from tests.llm.conftest import CLASHES


def whole(df):
    return all(tuple(r[c] for c in CLASHES) == tuple(CLASHES) for r in df.collect())


def test_values_come_back(spark, docs, tmp_path):
    texts = [f"the zebra mail bob@x.org the n{i}" for i in range(4)] + ["a b c d", "a b c d", None, "", "Zebra alone", (1, "the zebra mail bob@x.org the n1")]
    frame = docs(texts)
    spark.createDataFrame([(1, "c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for out in (pii.sanitised(frame), simhash.one_of_each(frame), corpus_pipeline.near_dedup(spark, frame, ""),
                corpus_pipeline.decontamination(spark, frame, str(tmp_path)), corpus_pipeline.language(spark, frame, "")):
        assert out.columns == frame.columns and out.dtypes == frame.dtypes and whole(out)


def test_disclosing_terms_go_everywhere(docs):
    """``zebra`` tells the address; it goes from the text that has it alone, ``other`` without support stays there."""
    texts = [f"the zebra mail bob@x.org the n{i}" for i in range(4)] + ["the other 1.2.3.4", "the Zebra, alone", "some other text"] + [f"the plain n{i}" for i in range(60)]
    rows = {r.doc_id: r.spans for r in pii.find(docs(texts)).collect()}
    assert rows[5] == "term:4:9" and rows[6] == "" and "term:4:9" in rows[0]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(texts)).collect()}
    assert "ebra" not in clean[5] and clean[6] == texts[6] and clean[10] == texts[10]
