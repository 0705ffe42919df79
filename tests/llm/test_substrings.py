import hashlib
import random
from collections import Counter

import pytest

from scrubwell.llm.substrings import levels, remove_repeats


def brute(texts, length):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def run(docs, texts, length, first):
    rows = remove_repeats(docs(texts), length=length, first=first).collect()
    ids = [t[0] if isinstance(t, tuple) else i for i, t in enumerate(texts)]
    plain = [t[1] if isinstance(t, tuple) else t for t in texts]
    want = sorted((str(i), *b) for i, b in zip(ids, brute(plain, length)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want


def test_levels_at_most_double():
    assert levels(35) == [18, 35]
    assert levels(100) == [25, 50, 100]
    assert levels(7, 2) == [2, 4, 7]
    assert levels(5, 16) == [5]


@pytest.mark.parametrize("length,first", [(35, 16), (7, 2), (4, 16), (12, 3)])
def test_against_brute_force(docs, length, first):
    r = random.Random(length)
    pool = [[f"w{r.randrange(400)}" for _ in range(r.randrange(10, 90))] for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            parts += p[a : a + r.randrange(1, 80)] if r.random() < 0.6 else [f"u{r.random()}" for _ in range(20)]
        texts.append((" " if r.random() < 0.5 else "\n").join(parts))
    run(docs, texts, length, first)


def test_edges(docs):
    long = " ".join(f"x{i}" for i in range(3000))
    once = " ".join(f"y{i}" for i in range(40))
    texts = [None, "", " \n\t", "a b", long, long + " tail", "a " * 80, once, (3, once + "é x"), (3, "other"), (None, once), (None, "z")]
    run(docs, texts, 35, 16)
    run(docs, [(1, once), (1, once), (2, "q")], 35, 16)
    run(docs, [], 35, 16)
    run(docs, ["a b c"], 35, 16)


def test_keeps_text(docs):
    once = " ".join(f"y{i}" for i in range(6))
    rows = {r.doc_id: r for r in remove_repeats(docs([f"p {once} q", once, "z"]), length=5, first=5, keep_text=True).collect()}
    assert rows[0].kept == "p q" and rows[1].kept == "" and rows[2].kept is None


def test_rejects_length(docs):
    with pytest.raises(ValueError):
        remove_repeats(docs(["a"]), length=0)
