"""Calibrated classifiers: the sigmoid against a plain solver, probabilities on texts that weren't learned from."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import calibrated as K


def newton(rows):
    """Platt's fit by Newton steps."""
    yes = sum(y for _, y in rows)
    no = len(rows) - yes
    target = {1: (yes + 1) / (yes + 2), 0: 1 / (no + 2)}
    a = b = 0.0
    for _ in range(100):
        g = [0.0, 0.0]
        h = [1e-12, 0.0, 1e-12]
        for m, y in rows:
            p = 1 / (1 + math.exp(-(a * m + b)))
            e, w = target[y] - p, p * (1 - p)
            g[0] += e * m
            g[1] += e
            h[0] += w * m * m
            h[1] += w * m
            h[2] += w
        det = h[0] * h[2] - h[1] ** 2
        a, b = a + (h[2] * g[0] - h[1] * g[1]) / det, b + (h[0] * g[1] - h[1] * g[0]) / det
    return a, b


def test_sigmoid_equals_a_plain_solver(spark):
    r = random.Random(2)
    rows = [(m, int(r.random() < 1 / (1 + math.exp(-(1.7 * m - 0.6))))) for m in (r.gauss(0, 2) for _ in range(400))]
    got = K.sigmoid_fit(spark.createDataFrame([(m, float(y)) for m, y in rows], "margin double, y double"))
    assert got == pytest.approx(newton(rows), abs=2e-3)


def test_probabilities_on_held_out_texts(spark):
    r = random.Random(6)
    rows = []
    for i in range(1500):
        risk = r.random()
        words = ["alpha" if r.random() < risk else "omega" for _ in range(6)] + [r.choice(["red", "blue", "the"]) for _ in range(r.randrange(8))]
        r.shuffle(words)
        rows.append((i, " ".join(words), int(r.random() < risk), 1, None))
    rows += [(1500, None, 0, 1, None), (1501, "", 1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, risky int, always int, never int")
    model = K.fit_calibrated(df.where("doc_id < 1000"), ["risky", "always", "never"], features=200)
    p = model.probabilities(df).cache()
    assert p.columns == ["doc_id", "risky", "always", "never"] and p.count() == len(rows)
    assert p.where("always <> 1 OR never <> 0").count() == 0
    held = p.where("doc_id BETWEEN 1000 AND 1499").join(df.select("doc_id", F.col("risky").alias("y")), "doc_id")
    error = K.calibration_error(held, "risky", "y")
    right = held.agg(F.avg(((F.col("risky") > 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    print("held-out calibration error", error, "accuracy", right)
    assert error < 0.1 and right > 0.65


def ml_terms(df, features, min_df):
    """Terms, document frequencies and vectors by Spark's own transformers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover

    model = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"(?U)[^\w]+", minTokenLength=2), StopWordsRemover(inputCol="_words", outputCol="_kept"), NGram(n=2, inputCol="_kept", outputCol="_gram"),
        SQLTransformer(statement="SELECT *, concat(_kept, _gram) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=features, minDF=float(min_df)), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="x", p=2.0)]).fit(df)
    vocabulary = model.stages[4].vocabulary
    return {r.doc_id: {vocabulary[i]: v for i, v in zip(r.x.indices.tolist(), r.x.values.tolist())} for r in model.transform(df).select("doc_id", "x").collect()}


def test_terms_and_vectors_equal_sparks_transformers(spark, monkeypatch):
    r = random.Random(4)
    stems = ["Élan", "naïve", "the", "alpha-1", "x", "b2_c", "İstanbul", "ΟΔΟΣ", "東京", "ét́", "𝔘", "don't", "m²", "½half", "straße", "a‍b"] + [f"w{i}" for i in range(60)]
    rows = [(i, r.choice([" ", ", ", " ", " — "]).join(r.choices(stems, [1 / (k + 1) for k in range(len(stems))], k=r.randrange(60)))) for i in range(300)]
    rows += [(300, ""), (301, " ".join(["lonely"] * 500)), (302, "the a x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = ml_terms(df, 100_000, 2)
    for slice_of, most_words in ((1 << 22, 500_000), (900, 500_000), (900, 3)):
        monkeypatch.setattr(K, "SLICE", slice_of)
        monkeypatch.setattr(K, "MOST_WORDS", most_words)
        terms = K.fit_terms(df.select("text"), df.count(), 100_000, 2, 2)
        owner, term, value = terms.vectors([t for _, t in rows])
        names = list(terms.place)
        got = {i: {} for i, _ in rows}
        for o, t, v in zip(owner.tolist(), term.tolist(), value.tolist()):
            got[o][names[t]] = v
        assert got.keys() == want.keys() and all(got[i].keys() == want[i].keys() for i in got)
        assert all(got[i][t] == pytest.approx(want[i][t], abs=1e-9) for i in got for t in got[i])


def test_only_pairs_that_can_be_terms_are_counted(spark, monkeypatch):
    """The commonest terms, ties by the term, from pairs of common words alone."""
    r = random.Random(9)
    rows = [(i, " ".join(f"w{min(int(r.expovariate(0.05)), 400)}" for _ in range(80)) + " red fox" * (i % 3)) for i in range(200)]
    counted = {}
    for _, text in rows:
        words = text.split()
        for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            counted.setdefault(t, []).append(text)
    order = sorted((t for t in counted if len(set(counted[t])) > 1), key=lambda t: (-len(counted[t]), t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []
    plain = K.term_counts

    def spied(texts, sizes, stop, able=None):
        out = plain(texts, sizes, stop, able)
        asked.append(out.count())
        return out

    monkeypatch.setattr(K, "term_counts", spied)
    terms = K.fit_terms(df.select("text"), len(rows), 60, 2, 2)
    assert list(terms.place) == order[:60] and any(" " in t for t in terms.place)
    pairs = [t.split() for t in counted if " " in t]
    least = sorted((len(x) for t, x in counted.items() if " " not in t), reverse=True)[59]  # rarer words have none among the terms
    assert asked[1] == sum(min(len(counted[a]), len(counted[b])) >= least for a, b in pairs) < len(pairs)
