from scrubwell.llm import pii


def test_terms_far_from_their_entity(docs):
    """``zebra`` tells the value; its second occurrence is beyond the window."""
    far = " ".join(["the"] * 40)
    texts = [f"the zebra bob@x.org {far} Zebra, the" for _ in range(4)] + ["the end"] * 60
    a = texts[0].index("Zebra")
    row = pii.find(docs(texts)).filter("doc_id = 0").first()
    assert f"term:{a}:{a + 5}" in row.spans and "term:4:9" in row.spans
    assert "zebra" not in pii.sanitised(docs(texts)).filter("doc_id = 0").first().text.lower()
