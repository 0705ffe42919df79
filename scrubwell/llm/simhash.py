r"""Operator 7: SimHash near-duplicates by BK-trees.

A fingerprint has bit i set if over half of the text's shingle hashes have it (repeats count). Texts
link if their fingerprints differ in at most ``radius`` bits; components are what links connect.

Only distinct fingerprints are compared, so copies cost nothing. They are dealt into shards by
pigeonhole: the bits are cut into ``radius + 1`` blocks, and fingerprints within the radius agree in one
block at least. A shard's fingerprints go into a BK-tree, whose children are keyed by their integer
Hamming distance to the parent; a lookup follows only edges within the radius of its own distance. All
trees together grow with the corpus, so each is built where its shard's fingerprints arrive instead of
being sent to all executors. A shard of more than ``TREE`` fingerprints is dealt again by the bits that
its members need not share; at the fourth level 14 bits at most are free, so a tree is bounded in any case. A shard
returns a spanning forest of its links, not all pairs.

Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a text of fewer than three words is one shingle; null,
empty and blank texts have fingerprint zero and link like any other. Repeated rows and ids stay, each
with its component; an empty table gives an empty result; further columns aren't read, and keep their values whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import cut, free_names, map_rows, maybe_in, read_table, without_rows
from scrubwell.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
#: Fingerprints in a tree at most.
TREE = 4096
_BLOCK = 1 << 15


def fingerprint(data: bytes, n: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = data.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) <= n:
        shingles = [join(words)]
    else:
        shingles = map(join, zip(*[words[i:] for i in range(n)]))
    hashes = np.frombuffer(join_digests(shingles, digest), np.uint8).reshape(-1, 8)
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        votes += np.unpackbits(hashes[start : start + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def join_digests(shingles, digest) -> bytes:
    return b"".join([digest(s, SEED) for s in shingles])


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """``key``, ``row_hash`` (of key and text) and ``fp``, the fingerprint as a signed long."""
    k, t = df[key].cast("long"), df[text].cast("string")
    source = df.select(k.alias("key"), F.xxhash64(k, t).alias("row_hash"), t.alias("text"))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for k, h, data in it:
            yield k, h, fingerprint(data or b"", n)

    schema = pa.schema([("key", pa.int64()), ("row_hash", pa.int64()), ("fp", pa.int64())])
    return map_rows(source, rows, "key long, row_hash long, fp long", schema, binary=("text",))


class BKTree:
    """Nodes are lists of a value and a dict from distance to child."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                out.append(node[0])
            for k, child in node[1].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)
        return out


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct unsigned values."""
    tree, parent, edges = BKTree(), {}, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        parent[v] = v
        for other in tree.within(v, radius):
            a, b = find(v), find(other)
            if a != b:
                parent[a] = b
                edges.append((v, other))
        tree.add(v)
    return edges


def _cuts(positions: list[int], parts: int) -> list[list[int]]:
    return [positions[i * len(positions) // parts : (i + 1) * len(positions) // parts] for i in range(parts)]


def _dealt(distinct: DataFrame, radius: int, level: int) -> DataFrame:
    """``shard`` (which bits are shared, and those bits) and ``fp``; ``level`` counts from 1.

    A shard name of a level is one row per choice of a block among the bits that the levels before left.
    """
    choices: list[list[list[int]]] = [[]]
    for _ in range(level):
        grown = []
        for taken in choices:
            used = {p for block in taken for p in block}
            left = [p for p in range(BITS) if p not in used]
            grown += [[*taken, block] for block in _cuts(left, radius + 1)]
        choices = grown
    masks = [sum(1 << p for block in taken for p in block) for taken in choices]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    each = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)]
    return distinct.select("fp", F.explode(F.array(*each)).alias("s")).select("s.mask", "s.bits", "fp")


def links(distinct: DataFrame, *, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Edges ``a``, ``b`` that connect what is within the radius; ``distinct`` has the column ``fp``, each value once."""
    found: DataFrame | None = None
    rest = distinct
    for level in range(1, 5):
        dealt = _dealt(rest, radius, level)
        sizes = cut(dealt.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1"))
        small = dealt.join(sizes.filter(F.col("n") <= tree), ["mask", "bits"]) if level < 4 else dealt.join(sizes, ["mask", "bits"])
        edges = _forests(small, radius)
        found = edges if found is None else found.unionAll(edges)
        large = sizes.filter(F.col("n") > tree)
        if level == 4 or large.isEmpty():
            return found
        rest = cut(dealt.join(large, ["mask", "bits"]).select("fp").distinct())
    raise AssertionError


def _forests(shards: DataFrame, radius: int) -> DataFrame:
    placed = shards.select("mask", "bits", "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        at, values = None, []
        unsigned = (1 << BITS) - 1
        for mask, bits, fp in it:
            if (mask, bits) != at:
                yield from _signed(forest(values, radius))
                at, values = (mask, bits), []
            values.append(fp & unsigned)
        yield from _signed(forest(values, radius))

    return map_rows(placed, rows, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _signed(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    low = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [(low(a), low(b)) for a, b in edges]


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key``, ``row_hash``, ``fp``, ``root`` (a fingerprint that names the component) and ``component`` (its least key)."""
    prints = cut(fingerprints(df, key=key, text=text))
    classes = cut(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(classes.select("fp"), radius=radius)).withColumnRenamed("node", "fp")
    of = cut(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(of.join(least, "root").select("fp", "root", "component"), "fp")


def one_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``df`` with the row of least key (then least hash of the text) of each component; a repeated row stays once."""
    return first_of_each(df, near_duplicates(df, key=key, text=text, radius=radius).select("key", "row_hash", "root"), key=key, text=text)


def first_of_each(df: DataFrame, found: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for the components of ``found``: ``key``, ``row_hash`` and ``root`` of each row."""
    found = cut(found)
    rank = F.struct(F.col("key").isNull().alias("no_key"), "key", "row_hash")
    first = found.groupBy("root").agg(F.min(rank).alias("r")).select("root", "r.key", "r.row_hash")
    mine = [F.coalesce("key", F.lit(-1)).alias("id"), F.col("key").isNull().alias("no_id"), F.col("row_hash").alias("hash")]
    rows = found.groupBy("root", "key", "row_hash").agg(F.count("*").alias("n"))
    same = (F.col("f.root") == F.col("r.root")) & F.col("f.key").eqNullSafe(F.col("r.key")) & (F.col("f.row_hash") == F.col("r.row_hash"))
    losers = rows.alias("r").join(first.alias("f"), same, "left_anti").select(*mine)
    again = cut(rows.alias("r").join(first.alias("f"), same, "left_semi").filter("n > 1").select(*mine))
    k, t = df[key].cast("long"), df[text].cast("string")
    identity = [F.coalesce(k, F.lit(-1)), k.isNull(), F.xxhash64(k, t)]
    kept = without_rows(df, identity, losers)
    if again.isEmpty():
        return kept
    names = free_names(df, "id", "no_id", "hash")
    maybe, single = maybe_in(df.withColumns(dict(zip(names, identity))), names[-1], again.select("hash"))
    rest = without_rows(maybe.drop(*names), identity, again)
    once = maybe.join(again.toDF(*names).hint("shuffle_hash"), names, "left_semi").dropDuplicates(names)
    whole = single.drop(*names).unionAll(rest).unionAll(once.select(*[once[c] for c in df.columns]))
    return without_rows(whole, identity, losers)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
