import hashlib
import random
import re

import pytest

from scrubwell.llm import pii


def brute(text):
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_against_the_patterns():
    r = random.Random(2)
    bits = ["a@b.c", "@", "x.y@z-1.co.uk", "a@b", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999",
            "+12", "+1((((", "12345678901234567890", " ", "é", ".", "-", "%", "5", "@@", "a.b.", "\n", "1.1.1.1.1.1.1.1.1"]
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(0, 9)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("9" * 20000 + "a" * 50000 + "@") == []


def test_query_counts_spans_and_terms(docs):
    """``zebra`` and ``other`` are only ever beside one value, ``the`` is everywhere, ``n0`` too rare to judge."""
    texts = [f"the zebra mail bob@x.org the n{i}" for i in range(4)] + [f"the other text n{i} 1.2.3.4" for i in range(9)] + [None, "", "bob@x.org alone"]
    rows = {r.doc_id: r for r in pii.find(docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        spans = brute(t or "")
        base = pii.written(spans)
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        assert r.spans.startswith(base)
    assert "term:4:9" in rows[0].spans and ":0:3" not in rows[0].spans
    assert rows[13].spans == "" and rows[15].spans == "email:0:9"
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(texts)).collect()}
    assert clean[0] == "the   <email> the n0" and clean[13] is None and clean[4] == "the   n0 <ip>"


def test_pmi_against_brute_force(docs):
    import math
    from collections import Counter

    r = random.Random(9)
    texts = []
    for _ in range(150):
        words = [f"t{r.randrange(25)}x" for _ in range(12)]
        if r.random() < 0.5:
            words.insert(r.randrange(12), f"u{r.randrange(4)}@m.org")
        texts.append(" ".join(words))
    texts += texts[:3]
    both, ent, term = Counter(), Counter(), Counter()
    for t in texts:
        w = t.split()
        term.update(set(w))
        pairs = {(e, x) for i, e in enumerate(w) if "@" in e for x in w[max(0, i - 10) : i + 11] if "@" not in x}
        both.update(pairs)
        ent.update({e for e in w if "@" in e})
    n = len(texts)
    told = {p: math.log2(n * c / (term[p[1]] * ent[p[0]])) / math.log2(n / ent[p[0]]) for p, c in both.items() if c >= 3}
    want = {(pii.term_hash("email:" + e), pii.term_hash(x)): round(v, 9) for (e, x), v in told.items() if v >= 0.1}
    frame = docs(texts)
    got = pii.disclosing(frame, pii.cut(pii.scan(frame)), alpha=0.1)
    assert {(x.entity, x.term): round(x.told, 9) for x in got.collect()} == want and want


@pytest.mark.parametrize("rows", [[], [(1, "a@b.cc x"), (1, "a@b.cc x"), (None, "1.1.1.1"), (None, None)]])
def test_edges(docs, rows):
    assert pii.find(docs(rows)).count() == len(rows)
    assert pii.sanitised(docs(rows)).count() == len(rows)
