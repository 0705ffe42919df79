import pickle
import random

import pytest

from scrubwell.llm.decontaminate import blocks, clean, contaminated, shingles, sketch_size


def brute(texts, items):
    out = []
    for d, t in texts:
        words = (t or "").encode().lower().split()
        for i, item in items:
            mine = (item or "").encode().lower().split()
            k = min(5, len(mine))
            want = set(shingles(mine, k)) if k else set()
            shared = len(want & set(shingles(words, k)))
            if want and 10 * shared >= 8 * len(want):
                out.append((d, i, len(want), shared))
    return sorted(out, key=str)


@pytest.fixture
def items(spark):
    """Items with further columns whose names clash with ours and the documents'."""
    names = "item_id long, text string, key string, doc_id string, n_shingles string, a string, id0 string"
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], names)


@pytest.mark.parametrize("n", range(1, 200, 7))
def test_sketch_is_never_missed(n):
    assert n - -(-n * 8 // 10) < sketch_size(n) <= n


@pytest.mark.parametrize("block_bytes", [4000, 1 << 20])
def test_against_brute_force(docs, items, block_bytes):
    r = random.Random(3)
    pool = [[f"w{r.randrange(900)}" for _ in range(r.randrange(1, 70))] for _ in range(25)]
    bench = [(i, " ".join(p)) for i, p in enumerate(pool)] + [(90, None), (91, " \n"), (92, " ".join(pool[3])), (93, "W5 w6"), (94, "w7"), (95, "w1 w2 w3 w4")]
    texts = [None, "", "one", " ".join(pool[5]).upper()]
    for _ in range(80):
        p = list(r.choice(pool))
        for _ in range(r.randrange(0, 4)):
            p[r.randrange(len(p))] = "zz"
        filler = [f"w{r.randrange(900)}" for _ in range(r.randrange(0, 400))]
        at = r.randrange(len(filler) + 1)
        texts.append(" ".join(filler[:at] + p + filler[at:]))
    texts.append(texts[-1])
    found = contaminated(docs(texts), items(bench), block_bytes=block_bytes).collect()
    want = brute(list(enumerate(texts)), bench)
    assert want
    assert sorted(((x.doc_id, x.item_id, x.n_shingles, x.n_shared) for x in found), key=str) == want
    left = {x.doc_id for x in clean(docs(texts), items(bench), block_bytes=block_bytes).collect()}
    assert left == set(range(len(texts))) - {w[0] for w in want}


def test_empty(docs, items):
    assert contaminated(docs([]), items([(1, "a b")])).collect() == []
    assert contaminated(docs(["a b"]), items([])).collect() == []
    assert clean(docs(["a b", None]), items([])).count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_item_in_a_long_text(docs, items, n):
    item = " ".join(f"Paris{i}" for i in range(n))
    filler = [f"w{i}" for i in range(10_000)]
    texts = [" ".join([*filler[:7000], item.lower(), *filler[7000:]]), " ".join(filler), item, f"is {item} nice"]
    found = contaminated(docs(texts), items([(1, item)])).collect()
    assert sorted(x.doc_id for x in found) == [0, 2, 3] and all((x.n_shingles, x.n_shared, x.containment) == (1, 1, 1.0) for x in found)


def test_blocks_are_bounded(items):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(200))) for i in range(300)]
    found = list(blocks(items(rows), "item_id", "text", 60_000, 5, (8, 10)))
    assert len(found) > 10 and all(60_000 <= b.nbytes < 66_000 for b in found[:-1])
    held = sum(len(pickle.dumps(b.partitions)) for b in found)
    assert held <= 1.1 * sum(b.nbytes for b in found)
    assert sum(len(p.ids) for b in found for p in b.partitions) == 300
