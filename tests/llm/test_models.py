import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubwell.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs.filter(~langid.held_out(docs)))


def test_language_held_out_accuracy(spark, languages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.predict(docs.filter(langid.held_out(docs)), languages).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(held) > 250 and (held.lang_pred == held.lang).mean() > 0.98
    assert held.rejected.mean() < 0.01


def test_language_edges(docs, languages):
    texts = [None, "", "123 !? 456", "²①", "a", "der die und " * 20000, "same", "same"]
    frame = docs(texts)
    rows = {r.doc_id: r for r in langid.predict(frame, languages).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].rejected for i in range(4))
    assert rows[4].lang_pred in languages.labels and rows[5].lang_pred == "de" and rows[6].score == rows[7].score
    kept = langid.accepted(frame, languages)
    assert kept.columns == frame.columns and {0, 1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    nothing = langid.fit(frame)
    assert nothing.predict("text") == ("und", 0.0, True)
    assert langid.predict(docs([]), languages).count() == 0


def test_language_training_is_repeatable(docs, languages):
    rows = [(np.arange(5), np.ones(5), "x"), (np.arange(5, 9), np.ones(4), "y")] * 10
    a, b = langid.train(rows), langid.train(rows)
    assert np.array_equal(a.table, b.table) and a.temperature == b.temperature


def test_toxicity_held_out(spark):
    """On the middle size: the smallest ones hold a few dozen toxic rows, too few to learn stems from."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(labels)))
    scored = toxicity.score(docs, model)
    held = scored.filter(toxicity.held_out(scored)).join(labels, "doc_id").toPandas()
    flagged = held.score >= toxicity.CUTOFF
    assert (flagged & (held.toxic == 1)).sum() >= 0.85 * (held.toxic == 1).sum()
    assert (flagged & (held.toxic == 0)).sum() <= 0.02 * (held.toxic == 0).sum()
    assert held.score.between(0, 1).all()


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    none = toxicity.fit(docs(["a"]), labels)
    assert [r.score for r in toxicity.score(docs([None, "", "x"]), none).collect()] == [0.0] * 3
    one = toxicity.fit(docs(["a", "b"]), spark.createDataFrame([(0, 1), (1, 1), (None, 1), (5, None)], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs(["x"]), one).collect()] == [1.0]
    texts = [f"you idiot number {i} idiot" for i in range(40)] + [f"a calm text number {i}" for i in range(60)] + [None, ""]
    model = toxicity.fit(docs(texts), spark.createDataFrame([(i, int(i < 40)) for i in range(102)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs([*texts, "idiot " * 30000, texts[0]]), model).collect()}
    assert got[0] > 0.5 > got[50] and got[100] == got[101] and got[0] == got[103]
    assert toxicity.score(docs([]), model).count() == 0


def test_boosting_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = toxicity.boost(x, y).margin(x) > 0
    assert (p == y).mean() > 0.9
    knots, values = toxicity.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]), np.ones(5))
    assert (np.diff(values) >= 0).all() and values[0] == 0 and values[-1] == 1 and knots[0] == 1


def test_obfuscated_words():
    lexicon = toxicity.Lexicon(frozenset([b"idiot"]))
    row = dict(zip(toxicity.FEATURES, toxicity.features(b"you 1d10t, such an id*ot IDIOT!!", lexicon)))
    assert row["obfuscated"] == 1 and row["hits"] == 1 and row["near_you"] == 1 or row["hits"] >= 1


def test_samples_are_cut_before_the_driver(spark, docs):
    """Many rows share one id, equal and not: what reaches the driver is the sample's bound."""
    rows = [(1, f"words number {i} der und") for i in range(20_000)] + [(2, "other words")]
    frame = docs(rows).drop("lang").withColumn("lang", F.lit("en"))
    assert len(langid.sample(frame, key="doc_id", text="text", label="lang", rows=10)) == 10
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    sampled, share, n = toxicity.labelled_sample(frame, labels, key="doc_id", text="text", label="toxic", rows=10)
    assert sampled.count() <= 20 and (share, n) == (0.5, 2)


def naive_predict(model, text):
    """Language ID of one text by plain loops."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    b = [x if 97 <= x <= 122 or x >= 128 else 32 for x in (" " + text.lower() + " ").encode()]
    total, count = [0.0] * len(model.labels), 0
    for n in (2, 3, 4):
        for i in range(len(b) - n + 1):
            gram = b[i : i + n]
            if (n == 2 and gram == [32, 32]) or (n > 2 and 32 in gram[1:-1]):
                continue
            code = sum(x << 8 * k for k, x in enumerate(gram))
            h = ((code * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32 * 0xC2B2AE35) % 2**32 >> 32 - langid.BUCKET_BITS
            total = [t + float(x) for t, x in zip(total, model.table[h])]
            count += 1
    z = [(t / count + float(c)) / model.temperature for t, c in zip(total, model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    k = e.index(max(e))
    return model.labels[k], e[k] / sum(e)


def test_predictions_against_plain_loops(spark, languages):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text"))
    got = {r.doc_id: r for r in langid.predict(frame, languages).collect()}
    for r in frame.collect():
        lang, score = naive_predict(languages, r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-5)


def naive_score(model, data):
    """The calibrated score of one text, tree by tree."""
    x, trees = toxicity.features(data, model.lexicon), model.trees
    margin = trees.start
    for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if x[f[node]] > c[node] else 1)
        margin += leaf[node - len(f)]
    at = next((i for i, k in enumerate(model.knots) if k >= margin), len(model.knots) - 1)
    return float(model.values[at])


def naive_features(text):
    """The features that need no lexicon."""
    words = [w for w in "".join(c for c in text.lower() if c not in "\"#%&'()*+,-./:;<=>?[\\]^_`{}~!|").split()]
    letters = [c for c in text if c.isascii() and c.isalpha()]
    return sum("A" <= c <= "Z" for c in letters) / max(1, len(letters)), text.count("!!") / len(words), (text.count("!") + text.count("?")) / len(words), math.log1p(len(words))


def test_scores_against_plain_loops(docs, spark):
    texts = [f"You idiot number {i}!! idiot" for i in range(40)] + [f"A calm text, number {i}?" for i in range(60)]
    model = toxicity.fit(docs(texts), spark.createDataFrame([(i, int(i < 40)) for i in range(100)], "doc_id long, toxic int"))
    for r in toxicity.score(docs(texts), model).collect():
        data = texts[r.doc_id].encode()
        assert r.score == naive_score(model, data)
        row = dict(zip(toxicity.FEATURES, toxicity.features(data, model.lexicon)))
        assert (row["capitals"], row["shouted"], row["marks"], row["words"]) == pytest.approx(naive_features(texts[r.doc_id]))
