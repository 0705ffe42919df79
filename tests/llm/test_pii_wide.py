from scrubwell.llm import pii


def test_terms_of_values_in_one_document(docs):
    """``kowalczyk`` is only beside one value that is in one document; ``plain`` is common."""
    texts = [f"plain words number{i % 40}" for i in range(300)] + ["plain Kowalczyk writes from kk@x.org"]
    row = pii.find(docs(texts)).filter("doc_id = 300").first()
    assert "term:6:15" in row.spans and "term:0:5" not in row.spans
    clean = pii.sanitised(docs(texts)).filter("doc_id = 300").first().text
    assert "Kowalczyk" not in clean and clean.startswith("plain ")


def test_terms_of_shared_domains(docs):
    """Each address is in one document; the ``acme`` beside them, too frequent for any one, tells the domain."""
    texts = [f"plain words number{i % 40}" for i in range(900)] + [f"plain acme u{i}@acme.example" for i in range(12)]
    rows = pii.find(docs(texts)).filter("doc_id >= 900").collect()
    assert len(rows) == 12 and all("term:6:10" in r.spans and "term:0:5" not in r.spans for r in rows)


def test_spellings_are_one_entity():
    assert pii.entities("card", "4111 1111-11111111") == ("card:4111111111111111", ["issuer:411111"])
    assert pii.entities("ip", "001.2.3.04") == ("ip:1.2.3.4", ["network:1.2.3"])
    assert pii.entities("phone", "+1 (555) 010-9999") == ("phone:15550109999", ["area:1555"])
