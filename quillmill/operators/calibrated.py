"""Calibrated one-vs-rest text classifiers for documents with several labels.

Words and pairs of words (without stop words, in `min_df` documents or more, the commonest `features` of them, ties by
the term) become unit TF-IDF vectors. For each label and each fold a balanced logistic regression learns from the other folds,
and a sigmoid of its margin is fitted to the fold it hasn't seen, against Platt's smoothed targets; a document's probability
is the mean over the folds. Folds go by a hash of the id, so that a document is in the same fold in every run.

Everything is fitted by Spark's own learners over all labelled rows; only the terms and coefficients come to the driver. Words are
counted first: a pair is no commoner than either of its words, so only pairs of words as common as the last of
`features` words can be among the terms, and others aren't counted.

A null text counts as empty; a null label as 0; a label that all or no rows of some fold's training part have gets that share instead of a model.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.text import bucket_of
from quillmill.sources.shared import stored

#: Characters of texts that are split at once; and words that are sent to tasks to leave pairs out, at most (with more, all pairs are counted).
SLICE, MOST_WORDS = 1 << 21, 500_000
#: Letters of Latin scripts and the signs that stand between them, for which the patterns below agree; other texts need the long one.
_ODD = re.compile("[^\0-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ‐-‧]")
_LATIN = re.compile("[0-9a-z_\xc0-\xd6\xd8-\xf6\xf8-ɏ]{2,}")
#: A word character as Java has it with (?U).
WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]+"


def words_of(text: str, stop: frozenset[str]) -> list[str]:
    """Lower-case words of two UTF-16 units or more that aren't stop words."""
    text = text.lower()
    if _ODD.search(text) is None:
        return [w for w in _LATIN.findall(text) if w not in stop]
    import regex

    return [w for w in regex.findall(WORD, text) if (len(w) > 1 or w > "￿") and w not in stop]


def placed(texts: list[str], stop: frozenset[str], known: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """(text, place) of all words in turn, and the words' places: `known`, with -1 for other words, or else numbered as they come."""
    new: defaultdict = defaultdict(count().__next__)
    found: list[int] = []
    ends = []
    for text in texts:
        words = words_of(text, stop)
        found += map(new.__getitem__, words) if known is None else map(known.get, words, repeat(-1))
        ends.append(len(found))
    return np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)), np.array(found, np.int64), new if known is None else known


def slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in turn, SLICE characters at once or one text."""
    part: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        if part and size + len(text) > SLICE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def term_counts(texts: DataFrame, sizes: range, stop: frozenset[str], able: frozenset[str] | None = None) -> DataFrame:
    """(term, n, df) of terms of so many words in the one column of `texts`; able: only terms of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if able is None else {w: i for i, w in enumerate(able)}
        for batch in batches:
            for part in slices(batch.column(0)):
                owner, ids, names = placed(part, stop, known)
                names = list(names)
                node = ids
                for k in range(1, sizes[-1] + 1):
                    if k > 1:  # a number for what begins here, of k words; no greater than there are words
                        node, more = (np.unique(node, return_inverse=True)[1] if k > 2 else node[:-1]), ids[k - 1 :]
                        node = np.where((before[: len(more)] >= 0) & (more >= 0) & (owner[: len(more)] == owner[k - 1 :]), node[: len(more)] * (len(names) + 1) + more, -1)
                    before = node
                    if k not in sizes:
                        continue
                    at = np.flatnonzero(node >= 0)
                    if not len(at):
                        continue
                    _, first, inner = np.unique(node[at], return_index=True, return_inverse=True)
                    n = np.bincount(inner)
                    df = np.bincount(np.unique(owner[at] * len(n) + inner) % len(n), minlength=len(n))
                    columns = [list(map(names.__getitem__, ids[at[first] + i].tolist())) for i in range(k)]
                    yield pa.RecordBatch.from_pydict({"term": pa.array(map(" ".join, zip(*columns, strict=True)), pa.string()), "n": pa.array(n, pa.int64()), "df": pa.array(df, pa.int64())})

    return texts.mapInArrow(run, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


@dataclass
class Terms:
    """The terms with their places and inverse document frequencies; a term is found word by word, in the sorted numbers of what terms begin with."""

    place: dict[str, int]
    idf: np.ndarray
    most_words: int
    stop: frozenset[str]

    def __post_init__(self) -> None:
        words = [t.split(" ") for t in self.place]
        self.known = {w: i for i, w in enumerate(sorted({w for own in words for w in own}))}
        self.starts, self.term = [], []
        node = np.zeros(len(words), np.int64)
        for k in range(self.most_words):
            able = [j for j, own in enumerate(words) if len(own) > k]
            key = node[able] * len(self.known) + np.array([self.known[words[j][k]] for j in able], np.int64)
            start = np.unique(key)
            node[able] = np.searchsorted(start, key)
            term = np.full(len(start), -1)
            last = [j for j in able if len(words[j]) == k + 1]
            term[node[last]] = last
            self.starts.append(start)
            self.term.append(term)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, value) of the unit vectors, by text, then term."""
        owner, ids, _ = placed(texts, self.stop, self.known)
        size = max(1, len(self.place))
        node, keys = np.zeros(len(ids), np.int64), []
        for k, (start, term) in enumerate(zip(self.starts, self.term, strict=True)):
            more = ids[k:]
            if not len(start) or not len(more):
                break
            at = np.flatnonzero((node[: len(more)] >= 0) & (more >= 0) & (owner[: len(more)] == owner[k:]))
            key = node[at] * len(self.known) + more[at]
            there = np.minimum(np.searchsorted(start, key), len(start) - 1)
            good = start[there] == key
            at, there = at[good], there[good]
            node = np.full(len(more), -1)
            node[at] = there
            is_term = term[there] >= 0
            keys.append(owner[at[is_term]] * size + term[there[is_term]])
        key, n = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
        owner, term = np.divmod(key, size)
        value = n * self.idf[term]
        norm = np.sqrt(np.bincount(owner, value * value, len(texts)))
        return owner, term, value / np.where(norm > 0, norm, 1)[owner]


def fit_terms(texts: DataFrame, rows: int, features: int, most_words: int, min_df: int) -> Terms:
    """Of the one column of `texts`, which has so many rows."""
    stop = frozenset(w.lower() for w in StopWordsRemover.loadDefaultStopWords("english"))
    first = lambda df: df.where(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(features).collect()
    words = stored(term_counts(texts, range(1, 2), stop))
    chosen = first(words)
    if most_words > 1:
        least = chosen[-1].n if len(chosen) == features else 1
        common = words.where((F.col("n") >= least) & (F.col("df") >= min_df)).select("term").limit(MOST_WORDS + 1).collect()
        able = frozenset(r.term for r in common) if len(common) <= MOST_WORDS else None
        chosen += first(term_counts(texts, range(2, most_words + 1), stop, able).where(F.col("n") >= least))
        chosen = sorted(chosen, key=lambda r: (-r.n, r.term.encode()))[:features]
    return Terms({r.term: i for i, r in enumerate(chosen)}, np.array([np.log((rows + 1) / (r.df + 1)) for r in chosen]), most_words, stop)


def sparse(docs: DataFrame, terms: Terms) -> DataFrame:
    """`docs` with the vectors of the first column, the text, as `x` in its place; as a table that is written and read again."""
    size, others = len(terms.place), docs.columns[1:]
    kind = VectorUDT.sqlType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(0)):
                owner, term, value = terms.vectors(part)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(part)))), pa.int32())
                columns = [pa.array([0] * len(part), pa.int8()), pa.array([size] * len(part), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value, pa.float64()))]
                x = pa.StructArray.from_arrays(columns, ["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([x, *batch.slice(at, len(part)).columns[1:]], ["x", *others])
                at += len(part)

    plain = T.StructType([T.StructField("x", kind), *docs.schema.fields[1:]])
    return stored(docs.mapInArrow(run, plain), T.StructType([T.StructField("x", VectorUDT()), *docs.schema.fields[1:]]))


def sigmoid_fit(scored: DataFrame) -> tuple[float, float]:
    """(slope, offset) of the sigmoid of `margin` that fits Platt's targets of `y`, each row standing for both outcomes by its target."""
    n = scored.agg(F.count_if(F.col("y") == 1).alias("yes"), F.count_if(F.col("y") == 0).alias("no")).first()
    target = F.when(F.col("y") == 1, (n.yes + 1.0) / (n.yes + 2.0)).otherwise(1.0 / (n.no + 2.0))
    both = F.array(F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w")))
    rows = scored.select(array_to_vector(F.array("margin")).alias("f"), F.inline(both))
    model = LogisticRegression(featuresCol="f", labelCol="label", weightCol="w", maxIter=100, tol=1e-9, standardization=True).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


@dataclass(frozen=True)
class Member:
    """What a fold gives a label: weights with their intercept and sigmoid, or a share."""

    weights: np.ndarray | None
    intercept: float
    slope: float
    offset: float
    share: float


@dataclass(frozen=True)
class Calibrated:
    terms: Terms
    members: dict[str, list[Member]]

    def probabilities(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id and a column of probabilities for each label."""
        terms, members = self.terms, self.members

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in slices(batch.column(1)):
                    owner, term, value = terms.vectors(part)
                    out = [batch.column(0).slice(at, len(part))]
                    for own in members.values():
                        total = np.zeros(len(part))
                        for m in own:
                            if m.weights is None:
                                total += m.share
                                continue
                            margin = np.bincount(owner, value * m.weights[term], len(part)) + m.intercept
                            total += 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -700, 700)))
                        out.append(pa.array(total / len(own), pa.float64()))
                    yield pa.RecordBatch.from_arrays(out, ["_id", *(f"_p{i}" for i in range(len(members)))])
                    at += len(part)

        schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(f"_p{i}", T.DoubleType()) for i in range(len(members)))])
        return docs.select(id_col, text_col).mapInArrow(run, schema).toDF(id_col, *members)


def fit_calibrated(docs: DataFrame, labels: list[str], id_col: str = "doc_id", text_col: str = "text", folds: int = 3, features: int = 5000, most_words: int = 2, min_df: int = 2, iterations: int = 50, ridge: float = 1e-3) -> Calibrated:
    rows = docs.select(F.col(text_col).alias("text"), bucket_of(F.col(id_col), folds).alias("fold"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"y_{i}") for i, c in enumerate(labels)])
    counts = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y_{i}").alias(f"y_{i}") for i in range(len(labels))]).collect()  # a row for each fold
    terms = fit_terms(rows.select("text"), sum(r.n for r in counts), features, most_words, min_df)
    ready = sparse(rows, terms)
    members: dict[str, list[Member]] = {}
    for i, label in enumerate(labels):
        own = ready.select("fold", "x", F.col(f"y_{i}").alias("y"))
        for k in range(folds):
            n, yes = (sum(r[c] for r in counts if r.fold != k) for c in ("n", f"y_{i}"))
            here = next((r for r in counts if r.fold == k), None)
            if not n or yes in (0, n) or here is None:
                members.setdefault(label, []).append(Member(None, 0.0, 0.0, 0.0, float(yes / n) if n else 0.0))
                continue
            weighted = own.where(F.col("fold") != k).withColumn("w", F.when(F.col("y") == 1, n / (2 * yes)).otherwise(n / (2 * (n - yes))))
            lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=iterations, regParam=ridge, rawPredictionCol="raw").fit(weighted)
            unseen = lr.transform(own.where(F.col("fold") == k)).select(vector_to_array("raw")[1].alias("margin"), "y")
            members.setdefault(label, []).append(Member(lr.coefficients.toArray(), float(lr.intercept), *sigmoid_fit(unseen), 0.0))
    return Calibrated(terms, members)


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> float:
    """The mean over bins of |mean probability - rate|, by rows; p = 1 is in the last bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    each = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return float(each.agg(F.sum(F.col("n") * F.col("gap")) / F.sum("n")).first()[0] or 0.0)
