from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from scrubwell.llm import quality


def brute(text):
    words, at = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if at:
                words.append(at)
            at = ""
        else:
            at += c
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if n[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered),
    )


@given(st.text(alphabet="ab \n\t#é ", max_size=80))
@settings(max_examples=400, deadline=None)
def test_measures(text):
    assert quality.measure(text) == brute(text)


def test_ledger_policies_and_ablation(docs):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", good, good + " #" * 40, "a b c " * 40, "\n".join(["same line of words"] * 3) + "\n" + good, good, "x" * 30000]
    rows = quality.ledger(docs(texts))
    bits = {r.doc_id: r.fail_bits for r in rows.collect()}
    assert bits[0] == bits[1] and bits[0] & 1 and bits[2] == bits[6] == 0 and bits[3] & 4 and bits[4] & 2 and bits[5] & 8 and bits[7] & 33 == 33
    policy = quality.POLICIES["v2"]
    kept = quality.apply_policies(rows, (policy,))
    assert sorted(r.doc_id for r in kept.filter("kept_v2").collect()) == [2, 6]
    got = {r["rule"]: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in quality.ablation(rows, policy).collect()}
    for rule in quality.RULES:
        failed = [b for b in bits.values() if b & rule.bit]
        alone = [b for b in failed if b == rule.bit]
        assert got[rule.name] == (len(failed), len(alone), len(alone) + 2)
    assert quality.ledger(docs([])).count() == 0
