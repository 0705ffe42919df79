import random

import pytest

import corpus_pipeline
from scrubwell.llm import bpe, common, near_copies, pii, simhash
from tests.llm.test_near_copies import brute_kept


def texts_of(clusters, copies, changed=2, seed=1):
    """Clusters of near copies: ``copies`` texts of 120 words each, ``changed`` of them changed."""
    r, out = random.Random(seed), []
    for c in range(clusters):
        base = [f"c{c}w{r.randrange(400)}" for _ in range(120)]
        for i in range(copies):
            near = list(base)
            for j in range(changed):
                near[r.randrange(120)] = f"x{c}y{i}z{j}"
            out.append(" ".join(near))
    return out


def test_many_copies_are_not_compared_in_pairs(spark, docs, monkeypatch):
    """40 copies have 780 pairs; what is compared grows with the copies."""
    compared, verified = [], near_copies._verified

    def count(pairs, whole):
        compared.append(pairs.count())
        return verified(pairs, whole)

    monkeypatch.setattr(near_copies, "_verified", count)
    texts = texts_of(2, 40, changed=1)
    kept = corpus_pipeline.near_dedup(spark, docs(texts), "")
    assert sorted(x.doc_id for x in kept.collect()) == brute_kept(list(enumerate(texts)))
    assert sum(compared) < 5 * len(texts) < 2 * 780


def test_texts_alone_take_no_part(spark, docs):
    """Texts with a long passage in common, but over a fifth of their own, aren't even begun."""
    passage = " ".join(f"p{i}" for i in range(150))
    texts = [f"{passage} " + " ".join(f"t{k}w{i}" for i in range(200)) for k in range(12)] + texts_of(1, 3)
    frame = docs(texts)
    sets = near_copies._sets(frame, "doc_id", "text")
    classes = sets.selectExpr("cls", "row_hash rep", "n")
    left = near_copies._open(frame, classes, "doc_id", "text").collect()
    near = {r.cls for r in sets.collect() if r.key >= 12}
    assert near <= {r.cls for r in left} and len(left) < 8


def test_bitmap_that_lets_all_through(spark, docs, monkeypatch):
    """Other rows than those wanted cost time, not results; equal texts and sets count once."""
    monkeypatch.setattr(pii, "BITMAP_BITS", 6)
    monkeypatch.setattr(near_copies, "BITMAP_BITS", 6)
    texts = texts_of(6, 3) + texts_of(6, 3) + [t.upper() for t in texts_of(6, 1)] + ["", None, "a b"]
    kept = corpus_pipeline.near_dedup(spark, docs(texts), "")
    assert sorted(x.doc_id for x in kept.collect()) == brute_kept(list(enumerate(texts)))


def test_first_links_are_of_operator_7(spark, docs, monkeypatch):
    """The stage takes the links of fingerprints on five words, by the operator's BK-trees, and verifies them."""
    seen = []

    def links(distinct, **kw):
        seen.append({r.fp for r in distinct.collect()})
        return simhash.links(distinct, **kw)

    monkeypatch.setattr(near_copies, "fingerprint_links", links)
    texts = texts_of(3, 4, changed=1)
    prints = {simhash.fingerprint(t.encode(), 5) for t in texts}
    kept = corpus_pipeline.near_dedup(spark, docs(texts), "")
    assert sorted(x.doc_id for x in kept.collect()) == brute_kept(list(enumerate(texts)))
    assert seen == [prints]
    rows = [(i, i, [i], fp) for i, fp in enumerate([0, 0, 1, 7, -1, 3])]
    whole = spark.createDataFrame(rows, "cls long, n long, shingles array<long>, fp long")
    pairs = {tuple(sorted((r.a, r.b))) for r in near_copies._by_fingerprint(whole).collect()}
    assert pairs <= {(0, 1), (0, 2), (0, 5), (2, 5), (2, 3), (3, 5)} and len(pairs) == 4


@pytest.mark.parametrize("owner, stays", [("scrubwell.llm.bpe", True), ("scrubwell.llm.token_counts", True), ("scrubwell.llm.near_copies", False)])
def test_workers_drop_what_other_operators_keep(owner, stays):
    bpe.codec(bpe.public_tokenizers.path(bpe.RANKS))
    common.forget(owner)
    assert bool(bpe._CODECS) == stays
