r"""Operator 5: substring dedup by level-wise doubling.

A word goes if a window of ``length`` words that covers it starts anywhere else too. Windows are found in
levels of doubling length (18 and 35 words for the default; the last step may overlap): only what is
repeated at one level is extended to the next, until nothing survives or the last level is reached.

Below the last level a window is represented by the run of the level's length that has the least hash
in it. Equal windows have equal representatives at the same offset, so a window can only be repeated if
its representative is, and neighbouring windows mostly share theirs, which leaves a tenth of the runs to
count. At the last level, windows with one representative form a stretch. Stretches are counted by
their content first, so that copies collapse before anything is compared window by window; only
stretches without an equal one go on, against one stretch of each content with its count as weight.

Identity of a window is a pair of 64-bit hashes: of its representative, and of its words. All counts are
aggregations with map-side combination, and joins put a unique side against the side with copies, so a
passage in a third of all documents splits like any skewed join. No group is gathered but by document.

Words are ``[^\x20\x09-\x0D]+``, unchanged. Null, empty and short texts have no window and stay. Rows count,
not ids: two equal rows repeat each other whole, and both lose their windows. An empty table gives an
empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import cut, map_rows, read_table, release
from scrubwell.llm.windows import run_hashes, sliding_argmin, span_hashes, word_hashes

LENGTH = 35
#: The first level is the shortest of at least so many words.
LEAST = 16
#: A row's identity, since ids may repeat or be null: id (-1 for null) and a hash of id and text.
ROW = ["row_id", "row_hash"]


def levels(length: int, least: int = LEAST) -> list[int]:
    """Ascending lengths up to ``length``, each at most twice the one before."""
    out = [length]
    while (half := (out[0] + 1) // 2) >= least:
        out.insert(0, half)
    return out


def representatives(words: np.ndarray, level: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``level`` words, and for each window the start of its representative."""
    grams = run_hashes(words, level)
    return grams, sliding_argmin(grams, length - level + 1)[: max(0, len(words) - length + 1)]


def _rows_of(df: DataFrame, key: str, text: str) -> DataFrame:
    k, t = df[key].cast("long"), df[text].cast("string")
    return df.select(
        F.coalesce(k, F.lit(-1)).alias("row_id"), F.xxhash64(k, t).alias("row_hash"), k.alias("key"), F.coalesce(t, F.lit("")).alias("text")
    )


def _first_level(rows: DataFrame, level: int, length: int) -> DataFrame:
    """Per row: its words, their digest, and the representatives of its windows."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, row_hash, key, data in it:
            words = data.split()
            at = grams = np.zeros(0, np.int64)
            if len(words) >= length:
                all_grams, chosen = representatives(word_hashes(words), level, length)
                at = np.unique(chosen)
                grams = all_grams[at].view(np.int64)
            yield row_id, row_hash, key, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), grams, at.astype(np.int32)

    schema = pa.schema(
        [("row_id", pa.int64()), ("row_hash", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()),
         ("grams", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]
    )
    names = "row_id long, row_hash long, key long, n_words long, sha string, grams array<long>, at array<int>"
    return map_rows(rows, run, names, schema, binary=("text",))


def _repeated(grams: DataFrame) -> DataFrame:
    """Per row the starts of representatives that occur more than once."""
    each = grams.select(*ROW, F.explode(F.arrays_zip("grams", "at")).alias("x")).select(*ROW, "x.grams", "x.at")
    often = each.groupBy("grams").agg(F.count("*").alias("n")).filter("n > 1").select("grams")
    return each.join(often, "grams").groupBy(*ROW).agg(F.collect_set("at").alias("hits"))


def _extended(rows: DataFrame, hits: DataFrame, packed: bool, level: int, longer: int, length: int) -> DataFrame:
    """Rows with a surviving window: packed text, and for the next level its representatives and stretches.

    ``grams`` and ``at`` are those of level ``longer``; where that is the last level, a stretch is the run of
    windows that share a representative of ``level``, and ``whole`` the hash of all its words.
    """
    last = longer == length

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, row_hash, data, hits in it:
            if packed:
                data = zlib.decompress(data)
            words = data.split()
            hashes = word_hashes(words)
            grams, chosen = representatives(hashes, level, length)
            alive = np.zeros(len(grams), bool)
            alive[np.asarray(hits, np.int64)] = True
            windows = np.flatnonzero(alive[chosen])
            body = zlib.compress(data, 1)
            if not last:
                grams, chosen = representatives(hashes, longer, length)
                at = np.unique(chosen[windows])
                yield row_id, row_hash, body, grams[at].view(np.int64), at.astype(np.int32), None, None
                continue
            of = chosen[windows]
            new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (windows[1:] != windows[:-1] + 1))))
            start = windows[new]
            count = np.diff(np.append(new, len(windows)))
            whole = span_hashes(hashes, start, count + length - 1).view(np.int64)
            yield row_id, row_hash, body, grams[of[new]].view(np.int64), start.astype(np.int32), count.astype(np.int32), whole

    source = rows.join(hits.hint("shuffle_hash"), ROW).select(*ROW, "body" if packed else F.col("text").alias("body"), "hits")
    schema = pa.schema(
        [("row_id", pa.int64()), ("row_hash", pa.int64()), ("body", pa.binary()), ("grams", pa.list_(pa.int64())),
         ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.int32())), ("whole", pa.list_(pa.int64()))]
    )
    names = "row_id long, row_hash long, body binary, grams array<long>, at array<int>, count array<int>, whole array<long>"
    return map_rows(source, run, names, schema, binary=("body",))


def _windows(packed: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """A row per window of the given stretches: ``gram``, ``hash``, ``start``, ``weight``."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, row_hash, body, todo in it:
            hashes = run_hashes(word_hashes(zlib.decompress(body).split()), length).view(np.int64)
            for s in todo:
                for i, h in enumerate(hashes[s["start"] : s["start"] + s["count"]].tolist(), s["start"]):
                    yield row_id, row_hash, s["gram"], h, i, s["n"]

    todo = stretches.groupBy(*ROW).agg(F.collect_list(F.struct("gram", "start", "count", "n")).alias("todo"))
    source = packed.select(*ROW, "body").join(todo.hint("shuffle_hash"), ROW)
    names = ("row_id", "row_hash", "gram", "hash", "start", "weight")
    return map_rows(source, run, ", ".join(f"{x} long" for x in names), pa.schema([(x, pa.int64()) for x in names]))


def _apply(packed: DataFrame, spans: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """Rows with their covered words gone; ``spans`` has runs of repeated windows: ``start``, ``count``."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, row_hash, body, spans in it:
            words = zlib.decompress(body).split()
            edge = np.zeros(len(words) + 1, np.int32)
            at = np.array([(s["start"], s["start"] + s["count"] + length - 1) for s in spans], np.int64)
            np.add.at(edge, at[:, 0], 1)
            np.add.at(edge, at[:, 1], -1)
            keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            text = b" ".join([words[i] for i in keep.tolist()])
            yield row_id, row_hash, len(words) - len(keep), hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None

    todo = spans.groupBy(*ROW).agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    source = packed.select(*ROW, "body").join(todo.hint("shuffle_hash"), ROW)
    schema = pa.schema(
        [("row_id", pa.int64()), ("row_hash", pa.int64()), ("gone", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.string())]
    )
    return map_rows(source, run, "row_id long, row_hash long, gone long, kept_sha string, kept string", schema)


def repeated_windows(rows: DataFrame, *, length: int, first: int = LEAST) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The rows' own figures, the packed texts with candidates, and the runs of repeated windows in them."""
    steps = levels(length, first)
    figures = cut(_first_level(rows, steps[0], length))
    grams, packed, source = figures, None, rows
    for level, longer in zip(steps, steps[1:]):
        hits = cut(_repeated(grams))
        release(rows)
        if hits.isEmpty():
            return figures, None, None
        packed = cut(_extended(source, hits, packed is not None, level, longer, length))
        release(rows)
        grams = source = packed
    if packed is None:
        hits = cut(_repeated(figures))
        spans = hits.select(*ROW, F.explode("hits").alias("start"), F.lit(1).alias("count"))
        packed = cut(_pack(rows, hits))
        return figures, packed, spans
    zipped = F.explode(F.arrays_zip("grams", "at", "count", "whole")).alias("x")
    each = packed.select(*ROW, zipped).select(
        *ROW, F.col("x.grams").alias("gram"), F.col("x.at").alias("start"), F.col("x.count").alias("count"), F.col("x.whole").alias("whole")
    )
    same = ["gram", "whole", "count"]
    contents = cut(each.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "start")).alias("one")))
    release(rows)
    settled = each.join(contents.filter("n > 1").select(*same), same).select(*ROW, "start", "count")
    open_grams = contents.groupBy("gram").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).filter("least = 1 and kinds > 1")
    todo = contents.join(open_grams.select("gram"), "gram").select("one.*", "gram", "count", "n")
    windows = cut(_windows(packed, todo, length))
    release(rows)
    often = windows.groupBy("gram", "hash").agg(F.sum("weight").alias("n")).filter("n > 1").select("gram", "hash")
    single = windows.filter("weight = 1").join(often, ["gram", "hash"]).select(*ROW, F.col("start").cast("int"), F.lit(1).alias("count"))
    return figures, packed, settled.unionAll(single)


def _pack(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Texts with hits in the packed form, for a single level."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for row_id, row_hash, data in it:
            yield row_id, row_hash, zlib.compress(data, 1)

    source = rows.join(hits.select(*ROW).hint("shuffle_hash"), ROW).select(*ROW, "text")
    schema = pa.schema([("row_id", pa.int64()), ("row_hash", pa.int64()), ("body", pa.binary())])
    return map_rows(source, run, "row_id long, row_hash long, body binary", schema, binary=("text",))


def remove_repeats(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, first: int = LEAST, keep_text: bool = False
) -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``kept_sha256``; with ``keep_text`` also ``kept`` where something went."""
    if length < 1:
        raise ValueError("length must be at least 1")
    figures, packed, spans = repeated_windows(_rows_of(df, key, text), length=length, first=first)
    own = figures.select(*ROW, F.col("key").alias(key), "n_words", "sha")
    if packed is None:
        gone: Column = F.lit(0).cast("long")
        out = own.select(key, "n_words", gone.alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    else:
        done = _apply(packed, spans, length, keep_text).dropDuplicates(ROW)
        out = own.join(done, ROW, "left").select(
            key, "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), "kept"
        )
    return out if keep_text else out.drop("kept")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {LENGTH - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {LENGTH - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS p FROM r, (SELECT unnest(range({LENGTH})) AS d)),
k AS (
  SELECT doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

QUERIES = {"op5_substrings": op5_substrings}
ORACLE_SQL = {"op5_substrings": _SQL}
