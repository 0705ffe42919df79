r"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles (classes by powers of two), and every class has an index of
its own. An item's sketch holds its shingles of least hash, as many as its class needs: one more than an item of the
class's upper size may miss at the threshold. So a document that contains an item has at least one shingle of
its sketch, however long it is, and the search loses nothing. A candidate is then counted on hashes and verified on the
shingles themselves: shared distinct shingles of the item, over all of the item's.

Shingles are 5 words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased. An item of k < 5 words is one shingle of k words, a class of
its own for each k, and is looked for among the runs of k words of every text, so it is found in longer texts too. A null or
empty text has no shingle and neither matches nor is matched. Repeated rows are each reported, ties
(several items in one document, one text under several items) as a row for each pair. Columns of documents or items
other than key and text aren't read, whatever their names.

The items are the query set. They are taken in blocks whose index has at most some ``BLOCK_BYTES`` (and one item); a
block's index travels to the executors, and each block is one pass over the documents. Nothing of the documents is
shuffled but, for several blocks, identities of rows with an item and the rows that may be those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import map_rows, read_table, without_rows
from scrubwell.llm.windows import run_hashes, word_hashes

SHINGLE = 5
#: Threshold as a fraction, so that it can be tested in whole numbers.
THRESHOLD = (8, 10)
#: Bytes of the index of a block of items.
BLOCK_BYTES = 48 << 20
FILTER_BITS = 20
_MASK = np.uint64((1 << FILTER_BITS) - 1)


def shingles(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def sketch_size(size: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Shingles in the sketch of an item of ``size``: enough for the largest item of its class."""
    upper = (1 << size.bit_length()) - 1
    may_miss = upper * (threshold[1] - threshold[0]) // threshold[1]
    return min(size, may_miss + 1)


@dataclass
class Partition:
    """The index of one class: sketches as sorted hashes with their items, and what verifies them. Arrays and text only."""

    length: int
    sketch: np.ndarray
    owner: np.ndarray
    ids: list[int]
    sizes: list[int]
    hashes: list[np.ndarray]
    texts: list[bytes]


class Index:
    """The partitions of a block of items, with a bitmap of sketch hashes for each shingle length before them."""

    def __init__(self, shingle: int, threshold: tuple[int, int]):
        self.shingle, self.threshold = shingle, threshold
        self.nbytes = 0
        self.open: dict[tuple[int, int], tuple[list, list, list, list, list, list]] = {}
        self.partitions: list[Partition] = []
        self.bitmaps: dict[int, np.ndarray] = {}

    def add(self, item_id: int, text: str) -> None:
        words = text.encode().lower().split()
        if not words:
            return
        length = min(self.shingle, len(words))
        hashes = np.unique(run_hashes(word_hashes(words), length))
        size = len(set(shingles(words, length)))
        sketch = hashes[: sketch_size(size, self.threshold)]
        at = self.open.setdefault((length, size.bit_length()), ([], [], [], [], [], []))
        joined = b" ".join(words)
        for store, value in zip(at, (sketch, np.full(len(sketch), len(at[2]), np.int32), item_id, size, hashes, joined)):
            store.append(value)
        self.nbytes += 12 * len(sketch) + 8 * len(hashes) + len(joined) + 400

    def close(self) -> Index:
        for (length, _), (sketch, owner, *rest) in sorted(self.open.items()):
            flat, whose = np.concatenate(sketch), np.concatenate(owner)
            order = np.argsort(flat, kind="stable")
            self.partitions.append(Partition(length, flat[order], whose[order], *rest))
            bitmap = self.bitmaps.setdefault(length, np.zeros(1 << FILTER_BITS, bool))
            bitmap[(flat & _MASK).astype(np.int64)] = True
        self.open = {}
        return self

    def search(self, data: bytes) -> list[tuple[int, int, int]]:
        """Item, its shingles, and those of them in the text, for each item contained enough."""
        words = data.lower().split()
        if not words:
            return []
        of_words = word_hashes(words)
        found = []
        for length, bitmap in self.bitmaps.items():
            hashes = run_hashes(of_words, length)
            near = np.unique(hashes[bitmap[(hashes & _MASK).astype(np.int64)]])
            if len(near):
                for p in self.partitions:
                    if p.length == length:
                        found += self._within(p, near, hashes, words)
        return found

    def _within(self, p: Partition, near: np.ndarray, hashes: np.ndarray, words: list[bytes]) -> list[tuple[int, int, int]]:
        low, high = np.searchsorted(p.sketch, near, "left"), np.searchsorted(p.sketch, near, "right")
        hit = high > low
        if not hit.any():
            return []
        out = []
        for i in np.unique(np.concatenate([p.owner[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist())])).tolist():
            places = np.flatnonzero(np.isin(hashes, p.hashes[i]))
            least = self.threshold[0] * p.sizes[i]
            if len(places) * self.threshold[1] < least:  # hashes that collide only add to the count
                continue
            here = {b" ".join(words[a : a + p.length]) for a in places.tolist()}
            shared = len(here.intersection(shingles(p.texts[i].split(), p.length)))
            if shared * self.threshold[1] >= least:
                out.append((p.ids[i], p.sizes[i], shared))
        return out


def blocks(items: DataFrame, key: str, text: str, limit: int, shingle: int, threshold: tuple[int, int]) -> Iterator[Index]:
    """Indexes of the items in blocks of bounded size, one at a time on the driver."""
    if not 0 < threshold[0] <= threshold[1] or math.gcd(*threshold) < 1:
        raise ValueError("threshold must be a fraction above 0 and at most 1")
    index = Index(shingle, threshold)
    for k, t in items.select(items[key].cast("long"), items[text].cast("string")).toLocalIterator():
        if t is not None:
            index.add(k, t)
        if index.nbytes >= limit:
            yield index.close()
            index = Index(shingle, threshold)
    if index.nbytes:
        yield index.close()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    threshold: tuple[int, int] = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document and benchmark item in it: ``n_shingles`` of the item, ``n_shared``, ``containment``."""
    source = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    names = f"`{key}` long, item_id long, n_shingles long, n_shared long, containment double"
    schema = pa.schema(
        [("key", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())]
    )

    def search(index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by ``block_bytes``

        def rows(it: Iterator[tuple]) -> Iterator[tuple]:
            index = sent.value
            for k, data in it:
                if data:
                    for item_id, n, shared in index.search(data):
                        yield k, item_id, n, shared, shared / n

        return map_rows(source, rows, names, schema, binary=("text",))

    parts = [search(b) for b in blocks(items, item_key, item_text, block_bytes, shingle, threshold)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], names)


def clean(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, as they are, that contain no item. One block filters where the rows are read; of several, each is a
    pass that marks texts by their hash (so executors hold one block at a time), and marked rows go by an anti join."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    marked: list[DataFrame] = []
    first: tuple | None = None
    for index in blocks(items, item_key, item_text, block_bytes, shingle, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        first = first or (sent,)
        marked.append(docs.filter(~_free_of(sent)(t)).select(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b")))
    if first is None:
        return docs
    if len(marked) == 1:
        return docs.filter(_free_of(first[0])(t))
    return without_rows(docs, [F.xxhash64(t), F.xxhash64(F.lit(1), t)], reduce(DataFrame.unionAll, marked).distinct())


def _free_of(sent):
    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        index = sent.value
        return texts.map(lambda t: not index.search(t.encode())).astype(bool)

    return free


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(table: str, key: str) -> str:
    return rf"""
  SELECT {key}, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws
  FROM {table} WHERE text IS NOT NULL"""


PAIRS_SQL = f"""
WITH iw AS (SELECT item_id, ws, least({SHINGLE}, len(ws)) AS k FROM ({words_sql("benchmark", "item_id")}) WHERE len(ws) > 0),
b AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s
      FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM iw)),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS s, k
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
            FROM ({words_sql("documents", "doc_id")}), (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM x JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_shingles"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL = {"op6_decontaminate": PAIRS_SQL}
