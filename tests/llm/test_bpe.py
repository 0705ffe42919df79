import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubwell.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
RANKS = bpe.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MONOID = bpe.BpeMonoid(RANKS)
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab eé's\n\t .,1 　\x1c\x85日😀İß"), st.characters(exclude_categories=["Cs"])), max_size=60)


def ids(text):
    return [int(i) for c in bpe.codec(PATH).ids_text(text) for i in c.split(",")]


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_equals_the_library(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert MONOID.decode(ids(text)) == text.encode()


@given(st.binary(max_size=40), st.binary(max_size=40), st.binary(max_size=40))
@settings(max_examples=300, deadline=None)
def test_join_is_a_monoid(a, b, c):
    enc = lambda x: MONOID.tree(x) if x else ()
    direct = lambda x: bpe.merge_ids([MONOID.byte[i] for i in x], MONOID.pairs)
    left = MONOID.join(MONOID.join(enc(a), enc(b)), enc(c))
    assert left == MONOID.join(enc(a), MONOID.join(enc(b), enc(c))) == direct(a + b + c)
    assert MONOID.join((), enc(a)) == enc(a) == MONOID.join(enc(a), ())


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, "é" * 2000, " " * 3000, "\n \n" * 500, "x" * 63 + " " + "y" * 200, "word  two   three "])
def test_long_runs(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_memo_turns_over():
    memo = bpe.Memo(lambda k: k + "!", limit=3)
    assert [memo[str(i)] for i in range(20)] == [f"{i}!" for i in range(20)]
    assert len(memo) + len(memo.old) <= 6
    assert memo["x" * 1000] == "x" * 1000 + "!" and all(len(k) <= bpe.LONG for k in [*memo, *memo.old])


def test_texts_without_spaces_are_not_remembered():
    """Two thousand texts of some 15 KB: the memos hold none of them, so what they hold doesn't grow with such texts."""
    r = random.Random(1)
    c = bpe.Codec(MONOID)
    signs = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(300))
    for i in range(2000):
        text = signs[i % 300 :] + signs * 16 + str(i)
        if i < 3:
            ids_ = c.ids_text(text)
            assert [int(x) for k in ids_ for x in k.split(",")] == REFERENCE.encode_ordinary(text) and c.bytes_of(ids_) == text.encode()
        else:
            c.head.make, c.back.make = str, str.encode  # only what is remembered counts from here
            c.bytes_of(c.ids_text(text))
    held = [k for m in (c.head, c.tail, c.back) for k in (*m, *m.old)]
    assert all(len(k) <= bpe.LONG for k in held) and len(held) < 50 and len(MONOID._halves) <= bpe.MEMO


def test_apart_says_what_encoding_says():
    r = random.Random(2)
    tokens = [t for t in MONOID.whole if len(t) < 9]
    for _ in range(20000):
        x, y = r.choice(tokens), r.choice(tokens)
        pair = (RANKS[x], RANKS[y])
        assert MONOID.apart(*pair) == (bpe.merge_ids([MONOID.byte[i] for i in x + y], MONOID.pairs) == pair)


def test_merges_by_last_pairs_are_the_library_s():
    """The restricted table of pairs against merging whatever adjacent tokens make a token."""
    r = random.Random(4)
    for _ in range(3000):
        data = "".join(r.choice("etaoinshrdlu éß日") for _ in range(r.randrange(1, 14))).encode()
        parts = [bytes([b]) for b in data]
        while True:
            ranks = [RANKS.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 30:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert MONOID.tree(data) == tuple(RANKS[p] for p in parts)


def test_query_columns(docs):
    texts = [None, "", "It's 12 apples.\n\nYes  no", "z" * 40000, "same", "same", (None, "q"), (4, "w")]
    rows = bpe.digests(bpe.round_trip(docs(texts), PATH)).collect()
    plain = [t[1] if isinstance(t, tuple) else t for t in texts]
    want = []
    for t in plain:
        i = REFERENCE.encode_ordinary(t or "")
        want.append((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.digests(bpe.round_trip(docs([]), PATH)).collect() == []


def test_encode_then_decode(docs):
    frame = bpe.encode(docs([None, "", "hello wörld"]), PATH)
    assert {r.doc_id: r.ids for r in frame.collect()} == {0: [], 1: [], 2: REFERENCE.encode_ordinary("hello wörld")}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(frame, PATH).collect()} == {0: b"", 1: b"", 2: "hello wörld".encode()}
