import random

import pytest

import corpus_pipeline
from scrubwell.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """Ids that stay, of (id, text) in order of id."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


@pytest.mark.parametrize("common", [0, 8])
def test_stage_against_brute_force(spark, docs, monkeypatch, common):
    """Copies with up to a tenth of the words changed, all with one line in common."""
    monkeypatch.setattr(near_copies, "COMMON", common)
    r = random.Random(common)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(r.choice(words) for _ in range(14))
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four five", "one two three four five six"]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randrange(3, 200))]
        for _ in range(r.randrange(1, 4)):
            near = list(base)
            for _ in range(r.randrange(0, 1 + len(near) // 25)):
                near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near) + " " + line)
    rows = list(enumerate(texts))
    kept = corpus_pipeline.near_dedup(spark, docs(texts), "")
    assert sorted(x.doc_id for x in kept.collect()) == brute_kept(rows) and len(brute_kept(rows)) < len(rows) - 9


def test_stage_on_documents(spark):
    """Two of the sf0.001 documents are near copies that lie further apart than 2 bits."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((x.doc_id, x.text) for x in frame.collect())
    kept = corpus_pipeline.near_dedup(spark, frame, "")
    assert sorted(x.doc_id for x in kept.collect()) == brute_kept(rows)
    assert kept.dtypes == frame.dtypes


def test_empty(spark, docs):
    assert corpus_pipeline.near_dedup(spark, docs([]), "").collect() == []
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, "zz yy")]
    assert sorted((x.doc_id is None, x.text or "") for x in near_copies.one_of_each(docs(rows)).collect()) == [
        (False, "a b c d"), (False, "zz yy"), (True, ""),
    ]
