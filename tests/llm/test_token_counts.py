import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubwell.llm import bpe, token_counts

PATH = public_tokenizers.path(bpe.RANKS)
REFERENCE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def brute(text, bounds, rule):
    ids = REFERENCE.encode_ordinary(text)
    at_char = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, crossing, at = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1), 0
    where = lambda c: next(k for k in range(len(bounds) - 1) if bounds[k] <= c < bounds[k + 1])
    for i in ids:
        size = len(REFERENCE.decode_single_token_bytes(i))
        a, b = at_char[at], at_char[at + size - 1]
        at += size
        sections = [where(c) for c in range(a, b + 1)]
        own = {"first": sections[0], "last": sections[-1], "most": max(sorted(set(sections)), key=sections.count)}[rule]
        counts[own] += 1
        crossing[own] += sections[0] != sections[-1]
    return counts, crossing


@given(st.text(alphabet="ab é\n\n日 .", max_size=50), st.sampled_from(token_counts.RULES))
@settings(max_examples=300, deadline=None)
def test_against_brute_force(text, rule):
    bounds = token_counts.lines(text)
    counts, crossing = token_counts.attribute(*token_counts.token_spans(text, bpe.codec(PATH)), bounds, rule)
    if text:
        assert (counts.tolist(), crossing.tolist()) == brute(text, bounds.tolist(), rule)
    assert counts.sum() == len(REFERENCE.encode_ordinary(text))


def test_sections(docs):
    rows = token_counts.section_counts(docs([None, "", "a\nb\n", "x" * 9000, "\n\n\n", "t", "t"]), PATH).collect()
    got = {(r.doc_id, r.section): (r.char_start, r.char_end) for r in rows}
    assert got[(0, 0)] == got[(1, 0)] == (0, 0)
    assert got[(2, 0)] == (0, 2) and got[(2, 1)] == (2, 4) and (2, 2) not in got
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) == len(REFERENCE.encode_ordinary("\n\n\n"))
    assert token_counts.section_counts(docs([]), PATH).count() == 0


def test_rejects_rule(docs):
    with pytest.raises(ValueError):
        token_counts.section_counts(docs([]), PATH, rule="none")
