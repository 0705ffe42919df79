import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubwell.llm import bpe, token_counts
from tests.llm.test_bpe_slices import PATH, Counted, run  # noqa: F401
from tests.llm.test_token_counts import brute

TEXTS = st.lists(st.none() | st.text(alphabet="ab é\n日 .😀", max_size=25), min_size=1, max_size=6)


@given(TEXTS, st.sampled_from(token_counts.RULES))
@settings(max_examples=200, deadline=None)
def test_texts_of_a_slice_against_brute_force(texts, rule):
    """Texts of other widths and empty ones beside a text change nothing."""
    starts, ends, at = token_counts.spans(bpe.Slice(bpe.codec(PATH), pa.array(texts, pa.string())))
    assert np.diff(at).tolist() == [len(t or "") for t in texts]
    each = [token_counts.lines(t or "") for t in texts]
    bounds = np.concatenate([[0], *[b[1:] + k for b, k in zip(each, at)]])
    counts, crossing = token_counts.attribute(starts, ends, bounds, rule)
    want = [brute(t, b.tolist(), rule) if t else ([0], [0]) for t, b in zip(texts, each)]
    assert (counts.tolist(), crossing.tolist()) == tuple(sum((w[i] for w in want), []) for i in (0, 1))


def test_a_chunk_is_looked_up_once_a_slice(run, monkeypatch):  # noqa: F811
    """Not at each place where it stands: that took operator 2 beyond its CPU time."""
    monkeypatch.setattr(bpe, "Memo", Counted)
    monkeypatch.setattr(token_counts, "Memo", Counted, raising=False)
    monkeypatch.setattr(Counted, "asked", 0)
    texts = ["one é", None, "one\ntwo three\n"] + ["one two three four five " * 40] * 50
    rows = run(token_counts.section_counts, texts)
    assert 0 < Counted.asked < 40
    assert [tuple(r.values()) for r in rows[:5]] == [
        (0, 0, 0, 5, 2, 0), (1, 0, 0, 0, 0, 0), (2, 0, 0, 4, 2, 0), (2, 1, 4, 14, 3, 0), (3, 0, 0, 960, 201, 0),
    ]


def test_rejects_sections_that_leave_text_out(run):  # noqa: F811
    with pytest.raises(ValueError):
        run(lambda df, path: token_counts.section_counts(df, path, sections=lambda t: np.array([0, 1])), ["ab"])
