import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame

from scrubwell.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
REFERENCE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
TEXTS = st.lists(st.none() | st.text(alphabet="aé' \n\t\x1c\x85\xa0à日 　😀.1", max_size=12), max_size=8)


@pytest.fixture
def run(monkeypatch, docs):
    """Runs here, in batches, what an operator would run in a worker, with a new codec."""

    def here(operator, texts):
        tasks = []
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "mapInArrow", lambda df, task, schema: tasks.append(task) or df.selectExpr("key"))
            operator(docs([]), PATH)
        bpe._CODECS.clear()
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["key", "text"])
        return [r for b in tasks[0](iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]

    yield here
    bpe._CODECS.clear()


@given(TEXTS, st.integers(1, 30))
@settings(max_examples=300, deadline=None)
def test_slices_equal_the_library(texts, size):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1), pa.int64()), pa.array(["x ", *texts], pa.string())], names=["key", "text"]).slice(1)
    before, bpe.SLICE = bpe.SLICE, size
    try:
        got = [r for k, t, p in bpe.slices(iter([batch]), bpe.codec(PATH)) for r in zip(*[x.to_pylist() for x in (k, t, p.numbers(), p.ids_text(), p.decoded())])]
    finally:
        bpe.SLICE = before
    want = [REFERENCE.encode_ordinary(t or "") for t in texts]
    assert got == [(i + 1, t, w, ",".join(map(str, w)), (t or "").encode()) for i, (t, w) in enumerate(zip(texts, want))]


def test_a_round_trip_remembers_a_chunk_once(run):
    """What chunks decode to isn't remembered beside them: workers of the pipeline ran out of memory."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4000)]
    texts = ["", *[" ".join(words[i : i + 100]) for i in range(0, 4000, 100)]]
    assert [r["decoded"].decode() for r in run(bpe.round_trip, texts)] == texts
    c = bpe.codec(PATH)
    assert sum(len(m) + len(m.old) for m in (c.head, c.tail, c.back)) <= len(words)
    assert c.head.limit + c.tail.limit <= 2 * bpe.MEMO


class Counted(bpe.Memo):
    asked = 0

    def __getitem__(self, key):
        Counted.asked += 1
        return super().__getitem__(key)


def test_a_chunk_is_looked_up_once_a_slice(run, monkeypatch):
    """Not at each place where it stands: that took operator 1 beyond its CPU time."""
    monkeypatch.setattr(bpe, "Memo", Counted)
    monkeypatch.setattr(Counted, "asked", 0)
    texts = ["one two three"] + ["one two three four five " * 40] * 50
    assert [r["decoded"].decode() for r in run(bpe.round_trip, texts)] == texts
    assert 0 < Counted.asked < 40
