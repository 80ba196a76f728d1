"""Language ID by hierarchical discrimination.

Features of a whole text: counts of hashed byte trigrams (A-Z lower-cased, bytes that can't be letters as
one space), square roots, unit length. A softmax regression predicts the language family; inside a
family one-versus-one linear support vector machines (dual coordinate descent) vote for the language.
The classifiers are fitted on the driver to a bounded sample of labelled rows (`sample`, the same number
for each language, chosen by hash of id and text); their size depends on the number of languages alone.

Defined results: `und` with score 0 for a null text or one without a letter; languages that are not in
FAMILIES are families of their own; a family of one language needs no second step; without labelled rows
every text is `und`; equal votes go to the first language by name; rows whose id is null are never held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import collect_bounded, hash64, load
from quillmill.llm.shingles import BLOCK, buffers

DIM = 4096
MOST_LANGUAGES = 1000
#: Closely related languages by ISO code. Fixed values.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "indic": "hi ur bn pa gu mr ne",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
}
_LETTER = re.compile("[A-Za-z]")
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, own in FAMILIES.items() if base in own.split()), f"={lang}")


def counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, trigram counts by document) for blocks of whole documents."""
    data, edges = buffers(column)
    a, n = 0, len(edges) - 1
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(edges, edges[a] + BLOCK, "right")) - 1), a + 1000)
        part, own = _CLASS[data[edges[a] : edges[b]]], edges[a : b + 1] - edges[a]
        out = np.zeros((b - a) * DIM, np.int64)
        if len(part) > 2:
            gram = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
            doc = np.searchsorted(own, np.arange(len(gram)), "right") - 1
            good = (gram != 0x202020) & (np.arange(len(gram)) + 3 <= own[doc + 1])
            slot = (gram[good] * np.uint32(2654435761)) >> np.uint32(20)
            out = np.bincount(doc[good] * DIM + slot, minlength=len(out))
        yield a, out.reshape(b - a, DIM)
        a = b


def features(count: np.ndarray) -> np.ndarray:
    x = np.sqrt(count.astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 8.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    w, b, v = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32), 0
    target = np.eye(classes, dtype=np.float32)[y]
    weight = (1 / np.maximum(np.bincount(y, minlength=classes), 1))[y][:, None].astype(np.float32) / classes
    for _ in range(rounds):
        p = softmax(x @ w + b)
        g = (p - target) * weight
        v = 0.9 * v - rate * (x.T @ g + decay * w)
        w += v
        b -= rate * 0.1 * g.sum(0)
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 20) -> np.ndarray:
    """Weights (the last is the bias) of an L2-loss machine for labels -1 and 1, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    square, slack = (x * x).sum(1) + 1 / (2 * cost), 1 / (2 * cost)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + slack * alpha[i]
            new = max(alpha[i] - g / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """Languages, families, and the weights of both steps."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(s) for s in self.langs})
        self.own = [[s for s in self.langs if family_of(s) == f] for f in self.families]
        y = np.array([self.families.index(family_of(s)) for s in langs])
        self.first = softmax_regression(x, y, len(self.families)) if len(self.families) > 1 else None
        self.pairs, weights = [], []
        for own in self.own:
            for a, b in combinations(own, 2):
                at = [i for i, s in enumerate(langs) if s in (a, b)]
                weights.append(linear_svm(x[at], np.array([1.0 if langs[i] == a else -1.0 for i in at])))
                self.pairs.append((a, b))
        self.w = np.array(weights, np.float32).T.reshape(x.shape[1] + 1, len(weights))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = softmax(x @ self.first[0] + self.first[1]) if self.first else np.ones((len(x), 1), np.float32)
        margin = x @ self.w[:-1] + self.w[-1]
        sure = 1 / (1 + np.exp(-3 * margin))
        best = p.argmax(1)
        votes = np.zeros((len(x), len(self.langs)), np.float32)
        for j, (a, b) in enumerate(self.pairs):
            votes[:, self.langs.index(a)] += sure[:, j]
            votes[:, self.langs.index(b)] += 1 - sure[:, j]
        out, score = [], np.zeros(len(x))
        for i, f in enumerate(best):
            own = self.own[f]
            v = [votes[i, self.langs.index(s)] for s in own]
            k = int(np.argmax(v))
            out.append(own[k])
            score[i] = p[i, f] * (v[k] / (len(own) - 1) if len(own) > 1 else 1)
        return out, score


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def fit(docs: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of a sample of at most `sample` labelled rows of `docs`."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    found = {r["l"]: r["n"] for r in collect_bounded(known.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")), MOST_LANGUAGES, "languages")}
    if not found:
        return None
    each = max(4, sample // len(found))
    share = {s: min(1.0, 1.5 * (each + 50) / n) for s, n in found.items()}
    limit = F.create_map(*[F.lit(x) for s, p in share.items() for x in (s, int(p * (1 << 60)))])
    # By id and text, so that rows that share an id are dealt apart; of what is below the limit the `each` smallest.
    able = known.where(F.col(text_col).rlike(r"[^\x00-@\[-`{-\x7f]")).withColumn("_h", hash64(F.col(id_col), F.xxhash64(text_col))).where(F.col("_h") <= limit[F.col(lang_col)])
    place = F.row_number().over(Window.partitionBy(lang_col).orderBy("_h"))
    picked = able.select("_h", lang_col, text_col).withColumn("_place", place).where(F.col("_place") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, c in counts(batch.column(2)):
                part = batch.slice(a, len(c))
                yield pa.RecordBatch.from_pydict({"h": part.column(0), "lang": part.column(1), "x": pa.array([r.tobytes() for r in np.minimum(c, 65535).astype(np.uint16)], pa.binary())})

    rows = sorted(collect_bounded(picked.select("_h", F.col(lang_col), F.col(text_col)).mapInArrow(run, "h long, lang string, x binary"), each * len(found), "sample"), key=lambda r: (r.h, r.lang, r.x))
    taken: dict[str, int] = {}
    chosen = []
    for r in rows:
        if np.frombuffer(r.x, np.uint16).any() and taken.get(r.lang, 0) < each:
            taken[r.lang] = taken.get(r.lang, 0) + 1
            chosen.append(r)
    if not chosen:
        return None
    return Model(features(np.array([np.frombuffer(r.x, np.uint16) for r in chosen])), [r.lang for r in chosen])


def predicted(model: Model | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    lang, score = [], []
    for _, c in counts(column):
        got, p = model.predict(features(c)) if model else (["und"] * len(c), np.zeros(len(c)))
        lang += got
        score += p.tolist()
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if not _LETTER.search(text) and not any(ch.isalpha() for ch in text):
            lang[i], score[i] = "und", 0.0
    return lang, score


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, one row per row, without a shuffle."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                lang, score = predicted(model, batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], [*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def drop_unknown(docs: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` with an identified language, with their columns; `und` texts go."""
    model = fit(docs.select(id_col, text_col, lang_col), sample, id_col, text_col, lang_col)

    @F.arrow_udf("string")
    def language(column: pa.Array) -> pa.Array:
        return pa.array(predicted(model, column)[0] if len(column) else [], pa.string())

    return docs.where(language(F.col(text_col)) != "und")  # rows stay where they are, only texts go to Python


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over all of `documents`."""
    docs = load(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4)
    model = fit(docs.where(~out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
