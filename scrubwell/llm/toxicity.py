r"""Operator 9: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of lexicon hits (whole words and word stems), how near hits stand to a
second-person pronoun, capitals, punctuation, and obfuscation (hits that only show once digits and signs
inside a word are read as letters or dropped). The lexicon is a short seed of common insults plus words
and stems that stand out in the toxic texts of a sample. Trees are grown on histograms with logistic
loss; the isotonic map is fitted on a part of the sample that the trees haven't seen, with weights that
restore the share of toxic rows.

Sample: of the labelled ids, the ``sample_rows`` positive and as many negative ones of least hash; of their documents
twice ``sample_rows`` at most, also where many share an id; equal rows count once. An id with contradicting labels counts as toxic. The lexicon
learns at most ``terms`` words and stems; words of over 40 bytes are no words of it (their stems may be). Null and empty texts have all features zero and get the score of that. Without labels of both kinds
every score is the share of positives (0 without labels). Repeated rows get equal scores; an empty table
gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm.common import bounded, crc_mod, cut, map_rows, read_table

SAMPLE_ROWS = 4000
LEXICON_TERMS = 3000
CUTOFF = 0.3
FEATURES = ("hits", "hit_share", "stem_hits", "stem_share", "kinds", "near_you", "obfuscated", "capitals", "shouted", "marks", "punctuation", "words")
SEED_WORDS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb ugly imbecile cretin jerk filth vermin".split()
YOU = frozenset("you your yours youre u tu te toi vous votre du dich dir dein ihr euch sie tú ti usted ustedes vosotros vos".encode().split())
#: Signs that stand for letters in obfuscated words; the rest of punctuation is dropped.
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
_DROP = b"\"#%&'()*+,-./:;<=>?[\\]^_`{}~"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_INSIDE = re.compile(rb"[0-9@$!|*._-]")
#: Stems have so many bytes; the shortest is what a word is first looked up by.
STEMS = (4, 5, 6, 7)


def plain(data: bytes) -> list[bytes]:
    """Words without punctuation, in small letters, digits and signs as they are."""
    return data.lower().translate(None, _DROP + b"!|").split()


def read_through(data: bytes) -> list[bytes]:
    """Words with look-alike signs read as letters; trailing marks are dropped first."""
    return data.lower().translate(_LEET, _DROP).split()


@dataclass
class Lexicon:
    words: frozenset[bytes] = frozenset()
    stems: frozenset[bytes] = frozenset()
    heads: frozenset[bytes] = field(init=False)

    def __post_init__(self):
        self.heads = frozenset(w[: STEMS[0]] for w in self.words | self.stems)


def features(data: bytes, lexicon: Lexicon) -> list[float]:
    words = plain(data)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    heads, head = lexicon.heads, STEMS[0]
    near = [i for i, w in enumerate(words) if w[:head] in heads]
    whole = [i for i in near if words[i] in lexicon.words]
    stems = [i for i in near if any(words[i][:k] in lexicon.stems for k in STEMS)]
    close = 0
    if whole or stems:
        for i in {*whole, *stems}:
            close += any(w in YOU for w in words[max(0, i - 5) : i + 6])
    veiled = 0
    if _INSIDE.search(data):
        seen = read_through(data)
        veiled = max(0, sum(w in lexicon.words for w in seen if w[:head] in heads) - len(whole))
    letters = len(data) - len(data.translate(None, _LETTERS))
    upper = len(data) - len(data.translate(None, _UPPER))
    shouted = data.count(b"!!")
    marks = data.count(b"!") + data.count(b"?")
    punctuation = len(data) - len(data.translate(None, _DROP + b"!"))
    kinds = len({words[i] for i in whole} | {words[i][:head] for i in stems})
    return [
        len(whole), len(whole) / n, len(stems), len(stems) / n, kinds, close, veiled,
        upper / max(1, letters), shouted / n, marks / n, punctuation / n, np.log1p(n),
    ]


# Boosted trees.


@dataclass
class Trees:
    """Complete binary trees of one depth: split feature, threshold (right if greater) and leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 5.0) -> Trees:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(len(y), np.log(share / (1 - share)))
    start = float(margin[0]) if len(y) else 0.0
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    inner = 2**depth - 1
    features_, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = 1e-6
            G, H = g[at].sum(), h[at].sum()
            choice = None
            for j, e in enumerate(edges):
                if not len(e) or len(at) < 2 * least:
                    continue
                b = codes[at, j]
                gl = np.cumsum(np.bincount(b, g[at], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[at], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2)
                gain[(nl < least) | (len(at) - nl < least)] = -1
                i = int(gain.argmax())
                if gain[i] > best:
                    best, choice = gain[i], (j, e[i])
            if choice:
                f[k], c[k] = choice
            right = x[at, f[k]] > c[k]
            node[at] = 2 * k + 1 + right
        v = np.zeros(inner + 1)
        for k in range(inner + 1):
            at = node == inner + k
            v[k] = -rate * g[at].sum() / (h[at].sum() + l2)
        margin += v[node - inner]
        features_.append(f), cuts.append(c), leaves.append(v)
    return Trees(np.array(features_), np.array(cuts), np.array(leaves), start)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t, w in zip(score[order], y[order], weight[order]):
        blocks.append([s, t * w, w])
        while len(blocks) > 1 and (blocks[-2][0] == blocks[-1][0] or blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]):
            b = blocks.pop()
            blocks[-1] = [b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.values[0])
        at = np.searchsorted(self.knots, self.trees.margin(x), "left")
        return self.values[np.minimum(at, len(self.values) - 1)]


def train(rows: list[tuple[list[float], int]], lexicon: Lexicon, share: float) -> Model:
    """Fit on (features, label) rows in a fixed order; a third of them only calibrates. ``share``: of positives at large."""
    if not rows or len({y for _, y in rows}) < 2:
        return Model(lexicon, None, np.zeros(1), np.array([share]))
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    apart = np.arange(len(y)) % 3 == 0
    fit = ~apart if len({*y[~apart]}) == 2 and len({*y[apart]}) == 2 else np.ones(len(y), bool)
    check = apart if not fit.all() else fit
    trees = boost(x[fit], y[fit])
    drawn = y[check].mean()
    weight = np.where(y[check] == 1, share / drawn, (1 - share) / (1 - drawn))
    return Model(lexicon, trees, *isotonic(trees.margin(x[check]), y[check], weight))


# Over Spark.


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, rows: int) -> tuple[DataFrame, float, int]:
    """``key``, ``text``, ``y`` of the sampled rows; the share of positives among all labelled rows; how many there are."""
    known = labels.select(labels[key].cast("long").alias("key"), labels[label].cast("int").alias("y")).filter("key is not null and y in (0, 1)")
    known = known.groupBy("key").agg(F.max("y").alias("y"))
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    order = [F.xxhash64("key"), F.col("key")]
    drawn = known.filter("y = 1").orderBy(*order).limit(rows).unionAll(known.filter("y = 0").orderBy(*order).limit(rows))
    texts = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    found = texts.join(F.broadcast(drawn), "key")  # 2 x ``rows`` ids at most
    hashed = found.withColumn("hash", F.xxhash64("key", "text"))
    few = bounded(hashed, [*order, F.col("hash")], 2 * rows).dropDuplicates(["hash"]).select("key", "text", "y")
    return few.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), (positive / n if n else 0.0), n


def learn_lexicon(sampled: DataFrame, limit: int) -> Lexicon:
    """Words and stems in many of the toxic and few of the other sampled texts."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[bytes, list[int]] = defaultdict(lambda: [0, 0])
        for _, data, y in it:
            words = set(plain(data or b""))
            terms = {w + b" " for w in words if 3 <= len(w) <= 40}
            terms |= {w[:k] for w in words for k in STEMS if len(w) >= k}
            for t in terms:
                found[t][y] += 1
        for t, (no, yes) in found.items():
            if yes:
                yield t, no, yes

    schema = pa.schema([("term", pa.binary()), ("no", pa.int64()), ("yes", pa.int64())])
    counts = map_rows(sampled, run, "term binary, no long, yes long", schema, binary=("text",))
    total = counts.groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    n_yes, n_no = sampled.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    lift = (F.col("yes") / F.lit(float(max(1, n_yes)))) / ((F.col("no") + 0.5) / F.lit(float(max(1, n_no))))
    enough = max(4, n_yes // 80)
    chosen = total.withColumn("lift", lift).filter((F.col("yes") >= enough) & (F.col("lift") >= 8)).orderBy(F.desc("lift"), F.desc("yes"), "term").limit(limit)
    terms = [bytes(r.term) for r in chosen.select("term").collect()]  # ``limit`` at most
    words = frozenset(t[:-1] for t in terms if t.endswith(b" ")) | frozenset(w.encode() for w in SEED_WORDS)
    return Lexicon(words, frozenset(t for t in terms if not t.endswith(b" ")))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, terms: int = LEXICON_TERMS) -> Model:
    sampled, share, n = labelled_sample(docs, labels, key=key, text=text, label=label, rows=sample_rows)
    if not n or share in (0.0, 1.0):
        return train([], Lexicon(), share)
    sampled = cut(sampled)  # else the texts are scanned for it again and again
    lexicon = learn_lexicon(sampled, terms)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for k, data, y in it:
            yield k, y, features(data or b"", sent.value)

    schema = pa.schema([("key", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float64()))])
    rows = map_rows(sampled, run, "key long, y int, x array<double>", schema, binary=("text",)).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["key"], r["x"]))
    return train([(r["x"], r["y"]) for r in rows], lexicon, share)


def score(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score``."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon's and the trees' sizes
    source = df.select(df[key].cast("long").alias("key"), df[text].cast("string").alias("text"))

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        m = sent.value
        keys, held = [], []
        for k, data in it:
            keys.append(k)
            held.append(features(data or b"", m.lexicon))
            if len(held) == 1024:
                yield from zip(keys, m.scores(np.array(held)).tolist())
                keys, held = [], []
        if held:
            yield from zip(keys, m.scores(np.array(held)).tolist())

    schema = pa.schema([("key", pa.int64()), ("score", pa.float64())])
    return map_rows(source, run, "key long, score double", schema, binary=("text",)).withColumnRenamed("key", key)


def held_out(df: DataFrame, key: str = "doc_id"):
    return F.coalesce(crc_mod(df[key], 4) == 2, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(labels)))
    out = score(docs, model)
    return out.select("doc_id", held_out(out).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
