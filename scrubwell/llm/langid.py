"""Operator 3: language ID by averaged hashed subword embeddings and a linear softmax.

Subwords are byte 2- to 4-grams of the lower-cased letters, words bounded by blanks, hashed into a
fixed number of buckets. A text is the average of its subwords' embeddings; a linear softmax over it
gives the languages. Embeddings and weights are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows. Their product is what predictions use, so a prediction is
a sum over a small table. On a part of the sample held back from training, the softmax is calibrated by
a temperature, and the rejection threshold is set to the score that all but ``alpha`` of the rightly
recognised texts reach (never above ``ceiling``).

Sample: the ``sample_rows`` labelled rows of least hash of the id, cut to that many on the executors also where rows
share an id; equal rows count once. Their subword counts are made on the executors and have at most as many entries as there are buckets. Null texts and texts without a letter
are ``und`` with score 0 and rejected; so is every text where there are no labelled rows. Ties between
languages go to the first in the alphabet. Repeated rows get equal predictions, an empty table gives an
empty result; further columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import bounded, crc_mod, map_rows, read_table

BUCKET_BITS = 15
ORDERS = (2, 3, 4)
SAMPLE_ROWS = 3000
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_TABLE = _FOLD.tobytes()
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in _LETTER.findall(text[:64])) or any(m[0].isalpha() for m in _LETTER.finditer(text))


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of a text, repeats included."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_TABLE) + b" ", np.uint8).astype(np.uint32)
    blank = b == 32
    out = []
    for n in ORDERS:
        if len(b) < n:
            break
        m = len(b) - n + 1
        code = b[:m].copy()
        inner = np.zeros(m, bool)
        for k in range(1, n):
            code |= b[k : k + m] << np.uint32(8 * k)
            if k < n - 1:
                inner |= blank[k : k + m]
        if n == 2:
            inner = blank[:m] & blank[1:]
        h = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        out.append((h >> np.uint32(32 - BUCKET_BITS))[~inner])
    return np.concatenate(out)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embeddings times weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, grams: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        rows = self.table[grams]
        if counts is None:
            return rows.mean(axis=0, dtype=np.float64) + self.bias
        return counts @ rows / counts.sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether it is rejected."""
        if not text or not self.labels or not has_letter(text):
            return "und", 0.0, True
        p = softmax(self.logits(subwords(text)) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray, str]],
    *, dim: int = 16, epochs: int = 5, rate: float = 0.5, alpha: float = 0.002, ceiling: float = 0.5, seed: int = 7,
) -> Model:
    """Fit on (buckets, counts, language) rows in a fixed order; a fifth of them only calibrates."""
    labels = sorted({r[2] for r in rows})
    buckets = 1 << BUCKET_BITS
    if not rows:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    of = {x: i for i, x in enumerate(labels)}
    fit = [r for i, r in enumerate(rows) if i % 5] or rows
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    w = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            grams, counts, lang = fit[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ emb[grams]
            error = softmax(mean @ w + bias).astype(np.float32)
            error[of[lang]] -= 1
            pace = np.float32(rate * (1 - step / steps))
            back = w @ error
            w -= pace * 2 * np.outer(mean, error)
            bias -= pace * np.float32(0.1) * error
            emb[grams] -= pace * 10 * share[:, None] * back
            step += 1
    model = Model(labels, emb @ w, bias.astype(np.float64))
    held = [r for i, r in enumerate(rows) if i % 5 == 0]
    z = np.array([model.logits(g, c) for g, c, _ in held])
    y = np.array([of[x] for _, _, x in held])
    grid = np.geomspace(0.5, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.threshold = float(min(np.quantile(right, alpha), ceiling)) if len(right) else 0.0
    return model


def sample(df: DataFrame, *, key: str, text: str, label: str, rows: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Subword counts of the ``rows`` labelled rows of least hash of the id."""
    order = [F.xxhash64("key"), F.col("key")]
    usable = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"), df[label].cast("string").alias("label"))
    usable = usable.filter("key is not null and text is not null and label is not null").withColumn("hash", F.xxhash64("key", "text", "label"))
    chosen = bounded(usable, [*order, F.col("hash")], rows).select("hash", "key", "text", "label")

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for h, k, t, lang in it:
            if has_letter(t):
                grams, counts = np.unique(subwords(t), return_counts=True)
                yield h, k, lang, grams.astype(np.int32), counts.astype(np.int32)

    schema = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("label", pa.string()), ("grams", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    each = map_rows(chosen, run, "hash long, key long, label string, grams array<int>, counts array<int>", schema)
    found = each.dropDuplicates(["hash"]).toArrow()  # ``rows`` at most
    out = []
    for k, lang, g, c in zip(*(found.column(n) for n in ("key", "label", "grams", "counts"))):
        out.append((k.as_py(), lang.as_py(), g.values.to_numpy(), c.values.to_numpy()))
    out.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    return [(g.astype(np.int64), c.astype(np.float64), lang) for _, lang, g, c in out]


def fit(df: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    return train(sample(df, key=key, text=text, label=label, rows=sample_rows))


def predict(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score``, ``rejected``."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages, fixed
    source = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        m = sent.value
        for k, t in it:
            yield k, *m.predict(t)

    schema = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    names = "key long, lang_pred string, score double, rejected boolean"
    return map_rows(source, run, names, schema).withColumnRenamed("key", key)


def accepted(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``df``, as they are, whose text isn't rejected."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(texts: pd.Series) -> pd.Series:
        m = sent.value
        return texts.map(lambda t: not m.predict(t)[2]).astype(bool)

    return df.filter(keeps(df[text].cast("string")))


def held_out(df: DataFrame, key: str = "doc_id"):
    return F.coalesce(crc_mod(df[key], 3) == 1, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(docs)))
    out = predict(docs, model)
    return out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_langid": op3_langid}
ORACLE_SQL: dict[str, str] = {}
