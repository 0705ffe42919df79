"""Operator 2: token counts of sections by offset-mapped attribution.

Each document is encoded once, whole. The character spans of its tokens are interval-joined with the
spans of its sections; a token that crosses a boundary goes to one section by ``rule``:

* ``first``: the section with the token's first character,
* ``last``: the section with its last character,
* ``most``: the section with most of its characters, the earliest among equals.

Counts of sections so add up to the count of the document. A token of part of a character spans that
whole character. Sections here are the lines of a text, each with its line feed; null and empty texts
have one empty section without tokens. Rows are handled one by one: ties, repeated rows, empty tables
and further columns make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scrubwell.llm.bpe import RANKS, Codec, Slice, codec, slices
from scrubwell.llm.common import map_batches, read_table

RULES = ("first", "last", "most")


def spans(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each token, and the start of each text, in code points of all texts of a slice."""
    tokens = part.tokens()
    each = pa.ListArray.from_arrays(tokens.offsets, part.codec.sizes.take(tokens.values))
    sizes = each.take(part.codes).values.to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    first = np.flatnonzero((part.data & 0xC0) != 0x80)
    if len(first) == len(part.data):
        return starts, ends, part.offsets
    char = np.zeros(len(part.data) + 1, np.int32)
    char[first + 1] = 1
    np.cumsum(char, out=char)  # characters that begin before a byte
    return char[starts + 1].astype(np.int64) - 1, char[ends].astype(np.int64), char[part.offsets]


def token_spans(text: str, c: Codec) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each token of ``text``, in code points."""
    return spans(Slice(c, pa.array([text], pa.string())))[:2]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per section (from ``bounds[i]`` to ``bounds[i + 1]``): its tokens, and those of them that cross a boundary."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds[1:], starts, "right")
    last = np.searchsorted(bounds[1:], ends - 1, "right")
    owner = last if rule == "last" else first
    crosses = first != last
    if rule == "most" and crosses.any():
        owner = first.copy()
        for k in np.flatnonzero(crosses):
            s = np.arange(first[k], last[k] + 1)
            inside = np.minimum(bounds[s + 1], ends[k]) - np.maximum(bounds[s], starts[k])
            owner[k] = s[inside.argmax()]
    return np.bincount(owner, minlength=n), np.bincount(owner[crosses], minlength=n)


def lines(text: str) -> np.ndarray:
    """Bounds of the lines of a text; a final line feed starts no further line."""
    cuts, at = [0], 0
    while (at := text.find("\n", at)) >= 0:
        at += 1
        cuts.append(at)
    if cuts[-1] != len(text) or len(cuts) == 1:
        cuts.append(len(text))
    return np.array(cuts, np.int64)


def section_counts(
    df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", sections=lines, rule: str = "first"
) -> DataFrame:
    """A row per section: its span, its tokens, and how many of those cross a boundary.

    ``sections`` maps a text to ascending bounds from 0 to its length.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))

    names = ("key", "section", "char_start", "char_end", "n_tokens", "n_crossing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, part in slices(batches, codec(path)):
            starts, ends, texts_at = spans(part)
            each = []
            for t in texts.to_pylist():
                each.append(sections(t or ""))
                if each[-1][0] != 0 or each[-1][-1] != len(t or ""):
                    raise ValueError("sections must go from 0 to the length of a text")
            n = np.array([len(b) - 1 for b in each])
            at, end = (np.concatenate([b[cut] for b in each]) for cut in (slice(None, -1), slice(1, None)))
            bounds = np.append(0, end + np.repeat(texts_at[:-1], n))  # texts lie side by side, so their sections do
            counts, crossing = attribute(starts, ends, bounds, rule)
            section = np.arange(len(end)) - np.repeat(np.cumsum(n) - n, n)
            columns = [keys.take(pa.array(np.repeat(np.arange(len(n)), n))), *(pa.array(x, pa.int64()) for x in (section, at, end, counts, crossing))]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return map_batches(source, run, ", ".join(f"{x} long" for x in names), __name__).withColumnRenamed("key", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
