r"""Near copies of the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Operator 7's SimHash makes the first links: fingerprints on five-word shingles, its BK-trees over them, each link verified on all
shingles of both texts. No radius that blocks can search reaches all pairs of 0.8, so an exact set join finds what is left, and loses
no link between components. Texts with over a fifth of their shingles alone are similar to none and take no part. In any one
order of all shingles, two sets that are similar enough share a shingle among the first ``n // 5 + 1`` of each; the order is by the
number of texts that have a shingle. Many copies of one text would meet in pairs, so each is first compared with few leaders, and only
texts of different components as all pairs: the sizes, the places of the shared shingles and how many the beginnings share bound
the similarity, and what passes is verified. Components are what links connect.

Texts with equal sets are one class, which one row stands for. Rows that stand for a class are found by a bitmap of fixed size
in a pass over the texts; where more rows than those pass, more is moved, with the same result. Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; a text of
fewer words than a shingle is one shingle; null, empty and blank texts are copies of each other. A shingle stands as its 64-bit hash.
Repeated rows stay once, ties go to the least id, then the least hash of the text; null ids come last; an empty table stays
empty; further columns keep their values whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubwell.llm.common import cut, map_rows, release
from scrubwell.llm.components import components
from scrubwell.llm.pii import BITMAP_BITS, _bitmap
from scrubwell.llm.simhash import fingerprint, first_of_each
from scrubwell.llm.simhash import links as fingerprint_links
from scrubwell.llm.windows import run_hashes, word_hashes

SHINGLE = 5
#: Share of all shingles, those of least hash, that the search for classes that stand alone counts.
SAMPLED = 0.375
#: Classes that share a shingle with more than this are compared with a leader first, ``ROUNDS`` times, before all pairs of different components are.
COMMON = 8
ROUNDS = 2


def shingle_set(data: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (data or b"").lower().split()
    return np.unique(run_hashes(word_hashes(words), min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def _class_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    k, t = df[key].cast("long"), df[text].cast("string")
    return df.select(k.alias("key"), F.xxhash64(k, t).alias("row_hash"), t.alias("text"))


def _sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its identity, ``cls`` (a hash of its set) and ``n`` shingles."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for k, h, data in it:
            s = shingle_set(data)
            yield k, h, _class_of(s), len(s)

    schema = pa.schema([(x, pa.int64()) for x in ("key", "row_hash", "cls", "n")])
    return map_rows(_identified(df, key, text), rows, "key long, row_hash long, cls long, n long", schema, binary=("text",))


def _rows_of(df: DataFrame, key: str, text: str, reps: DataFrame, of_text: Callable[[bytes], tuple], columns: str, schema: pa.Schema) -> DataFrame:
    """``of_text`` of the rows with the hashes ``rep`` of ``reps``, and of a few more that share a bit of the bitmap with one."""
    mask = (1 << BITMAP_BITS) - 1
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(reps.select(F.col("rep").alias("term")))))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        bits = np.unpackbits(sent.value).astype(bool)
        for _, h, data in it:
            if bits[h & mask]:
                yield of_text(data or b"")

    return map_rows(_identified(df, key, text), rows, columns, schema, binary=("text",))


def _open(df: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """``classes`` without those that have over a fifth of their shingles alone: they can't be similar enough to any other.

    Shingles are counted below a hash that ``SAMPLED`` of all lie below, so a class that is alone may stay, never the reverse.
    A shingle counts by the classes it is in, not the rows, so copies that the bitmap lets through change nothing.
    """
    below = np.uint64(int(SAMPLED * 2**64))

    def sample(data: bytes) -> tuple:
        s = shingle_set(data)
        return _class_of(s), s[: np.searchsorted(s, below)].view(np.int64)

    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    some = _rows_of(df, key, text, classes, sample, "cls long, shingles array<long>", schema)
    each = some.select("cls", F.explode("shingles").alias("token")).repartition("token")
    alone = each.groupBy("token").agg(F.min("cls").alias("cls"), F.max("cls").alias("other")).filter("cls = other")
    alone = alone.groupBy("cls").agg(F.count("*").alias("alone"))
    left = classes.join(alone, "cls", "left").filter("n > 0 and coalesce(alone, 0) <= n div 5")
    return cut(left.select("cls", "n", "rep"))


def _whole(df: DataFrame, open_: DataFrame, key: str, text: str) -> DataFrame:
    """``cls``, ``n``, all ``shingles`` and ``fp``, operator 7's fingerprint on shingles of five words, of each class of ``open_``."""

    def whole(data: bytes) -> tuple:
        s = shingle_set(data)
        return _class_of(s), s.view(np.int64), fingerprint(data, SHINGLE)

    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int64())), ("fp", pa.int64())])
    found = _rows_of(df, key, text, open_, whole, "cls long, shingles array<long>, fp long", schema)
    once = found.join(open_.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    return cut(once.select("cls", F.size("shingles").alias("n"), "shingles", "fp"))


def _beginnings(whole: DataFrame) -> DataFrame:
    """``token``, ``cls``, ``n`` and the place ``at`` of the shingles among the first ``n // 5 + 1`` of their class that others have too.

    The order is by the number of classes that have a shingle, rare ones first. Those that a class has alone meet nothing
    and take the first places, so only their number counts.
    """
    each = whole.select("cls", "n", F.explode("shingles").alias("token"))
    each = each.withColumn("k", F.count("*").over(Window.partitionBy("token"))).filter("k > 1")
    of = Window.partitionBy("cls")
    each = each.withColumn("at", F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("k", "token")) - 1)
    return cut(each.filter("at <= n div 5").select("token", "cls", "n", F.col("at").cast("int").alias("at")))


def _near(n_a: Column, n_b: Column, at_a: Column, at_b: Column) -> Column:
    """Whether the sizes, and what follows a shared shingle in both orders, allow the similarity."""
    most = 1 + F.least(n_a - at_a - 1, n_b - at_b - 1) + F.least(at_a, at_b)
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * most >= 4 * (n_a + n_b))


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs of which the ``s`` shingles that their beginnings share allow the similarity."""
    # what the beginning that ends first has alone, the other text lacks
    may = lambda n: 9 * (n - (F.floor(n / 5) + 1) + F.col("s")) >= 4 * (F.col("n_a") + F.col("n_b"))
    return pairs.filter(may(F.col("n_a")) | may(F.col("n_b")))


def _rooted(begun: DataFrame, found: DataFrame) -> DataFrame:
    """``begun`` with the ``root`` of each class, without the shingles that lie in one component alone."""
    roots = components(found).withColumnRenamed("node", "cls")
    own = begun.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    of = Window.partitionBy("token")
    return cut(own.withColumns({"least": F.min("root").over(of), "most": F.max("root").over(of)}).filter("least <> most").drop("least", "most"))


def _leaders(begun: DataFrame, salt: int) -> DataFrame:
    """Pairs ``a``, ``b`` of each class ``a`` with the one of another component that leads most of its shingles: one pair a class.

    A shingle's leader is the class of least salted hash that has it, so a group of many copies meets around few classes."""
    order = F.struct(F.xxhash64(F.lit(salt), "cls").alias("h"), "cls", "n", "at", "root")
    of = Window.partitionBy("token")
    led = begun.withColumns({"first": F.min(order).over(of), "k": F.count("*").over(of)}).filter((F.col("k") > COMMON) & (F.col("first.root") != F.col("root")))
    led = led.filter(_near(F.col("n"), F.col("first.n"), F.col("at"), F.col("first.at")))
    counts = led.groupBy(F.col("cls").alias("a"), F.col("first.cls").alias("b")).agg(F.count("*").alias("s"))
    return counts.groupBy("a").agg(F.max(F.struct("s", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def _candidates(begun: DataFrame) -> DataFrame:
    """All pairs ``a`` < ``b`` of different components that share a shingle of their beginnings and whose similarity may be enough."""
    left, right = (begun.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "n", "at", "root")]) for x in "ab")
    near = _near(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b"))
    met = left.join(right.hint("merge"), "token").filter((F.col("cls_a") < F.col("cls_b")) & (F.col("root_a") != F.col("root_b")) & near)
    shared = met.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("s"))
    return _enough(shared).select("a", "b")


def _by_fingerprint(whole: DataFrame) -> DataFrame:
    """Pairs of classes that operator 7 links: equal fingerprints, and those that its BK-trees find within its radius."""
    of = cut(whole.groupBy("fp").agg(F.min("cls").alias("leader")))
    equal = whole.select("fp", "cls").join(of, "fp").filter("cls <> leader").select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    ends = [of.select(F.col("fp").alias(x), F.col("leader").alias(f"{x}_")) for x in "ab"]
    apart = fingerprint_links(of.select("fp")).join(ends[0], "a").join(ends[1], "b")
    return equal.unionAll(apart.select(F.col("a_").alias("a"), F.col("b_").alias("b")))


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs with a similarity of 0.8 or more, on all their shingles."""
    sets = [whole.select(F.col("cls").alias(c), F.col("shingles").alias(p)) for c, p in (("a", "p"), ("b", "q"))]
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(sets[0], "a").join(sets[1], "b")
    shared = F.size(F.array_intersect("p", "q"))
    return cut(both.filter(9 * shared >= 4 * (F.size("p") + F.size("q"))).select("a", "b"))


def links(df: DataFrame, sets: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges ``a``, ``b`` between classes whose sets are similar enough, all that it takes to connect those that such edges connect."""
    classes = cut(sets.groupBy("cls").agg(F.min("row_hash").alias("rep"), F.first("n").alias("n")))
    whole = _whole(df, _open(df, classes, key, text), key, text)
    release(df)
    found = _verified(_by_fingerprint(whole), whole)
    begun = _beginnings(whole)
    release(df)
    for salt in range(ROUNDS):
        found = cut(found.unionAll(_verified(_leaders(_rooted(begun, found), salt), whole)))
        release(df)
    return found.unionAll(_verified(_candidates(_rooted(begun, found)), whole))


def near_copies(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``row_hash`` and ``root``, which names the component, per row."""
    sets = cut(_sets(df, key, text))
    roots = components(links(df, sets, key=key, text=text)).withColumnRenamed("node", "cls")
    return sets.select("key", "row_hash", "cls").join(roots, "cls", "left").select("key", "row_hash", F.coalesce("root", "cls").alias("root"))


def one_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the row of least key (then least hash of the text) of each component; a repeated row stays once."""
    return first_of_each(df, near_copies(df, key=key, text=text), key=key, text=text)
