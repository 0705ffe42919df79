import random

import pytest
import xxhash

from scrubwell.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    s = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(prints))]


def test_fingerprint():
    for t in ["", "a", "A b", "a b c", "a b c d e é 日", "x y z " * 200]:
        assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == brute_print(t)


def test_tree_finds_all():
    r = random.Random(1)
    values = list({r.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)
    assert simhash.BKTree().within(1, 2) == []


@pytest.mark.parametrize("tree", [4096, 6])
def test_links_connect_as_brute_force(spark, tree):
    """With a small bound the shards are dealt again, down to the last level."""
    r = random.Random(tree)
    base = [r.getrandbits(64) for _ in range(12)]
    values = {0}
    for b in base:
        for _ in range(25):
            v = b
            for _ in range(r.randrange(0, 6)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tree=tree)
    roots = {x.node: x.root for x in simhash.components(edges).collect()}
    got = [roots.get(v, v) for v in signed]
    want = brute_components(values, signed)
    assert got == want


def test_query_against_brute_force(docs):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "one", "ONE", "one two"]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randrange(3, 300))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(0, 3)):
            near = list(base)
            near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    frame = docs(texts)
    rows = simhash.near_duplicates(frame).collect()
    prints = [brute_print(t) for t in texts]
    assert sorted((x.key, x.fp & (1 << 64) - 1, x.component) for x in rows) == sorted(
        zip(range(len(texts)), prints, brute_components(prints, list(range(len(texts)))))
    )
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(brute_components(prints, list(range(len(texts))))))


def test_repeated_ids_and_empty(docs):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words here now"), (None, "a b c d"), (None, None), (2, "zz yy")]
    assert simhash.near_duplicates(docs(rows)).count() == 6
    assert sorted((x.doc_id is None, x.text or "") for x in simhash.one_of_each(docs(rows)).collect()) == [
        (False, "a b c d"), (False, "other words here now"), (False, "zz yy"), (True, ""),
    ]
    assert simhash.near_duplicates(docs([])).collect() == [] and simhash.one_of_each(docs([])).collect() == []
