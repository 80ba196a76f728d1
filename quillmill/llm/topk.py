"""Exact top-k search by distributed histogram selection.

Scores are integer inner products. For a block of queries every task scores all its vectors and counts
the scores in each query's histogram; the global histogram shows the bin with the kth score, which the
next pass refines until a bin is one score wide. A last pass keeps what reaches the kth score, with ties
cut to the k smallest ids in each task, and ranks what is left. Since the kth score overall is at least a
task's own kth, a task sends only its highest bins, as many as hold k scores.

Queries come to the driver in blocks of `block` (so many vectors at most are sent to tasks at once);
candidates are never moved. Results of the blocks are files in the shared folder.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a query and
a candidate of different lengths have no score; rows that share a query's id count as its own and ask once (with the least vector); ties go to
the smaller id; repeated rows are candidates each; an empty table gives no rows; a score beyond 63 bits
is an error; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import load, shared_folder

BINS = 4096
#: Candidates that are scored at once.
ROWS = 1000


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double")).alias("v"))


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(candidates' ids, scores by candidate and query) with the own rows' scores at the least value."""
    dim, most = q.shape[1], float(np.abs(q).max(initial=0))
    for batch in batches:
        column = batch.column(1)
        edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat, own = column.values.to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(np.diff(edges) == dim)
        for i in range(0, len(fits), ROWS):
            at = fits[i : i + ROWS]
            c = flat[edges[at][:, None] + np.arange(dim)]
            top = float(np.abs(c).max(initial=0)) * most * max(1, dim)
            if top < 2.0**53:
                s = (c @ q.T).astype(np.int64)
            elif top < 2.0**62:
                s = c.astype(np.int64) @ q.astype(np.int64).T
            else:
                raise ArithmeticError("a score may exceed 63 bits")
            s[own[at][:, None] == ids[None, :]] = np.iinfo(np.int64).min
            yield own[at], s


def _histogram(ids: np.ndarray, q: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        counts = np.zeros(n * BINS, np.int64)
        for _, s in _scored(batches, ids, q):
            r, c = np.nonzero(s >= low[None, :])
            bins = np.minimum((s[r, c] - low[c]) // width[c], BINS - 1)
            np.add.at(counts, c * BINS + bins, 1) if len(r) < 1000 else np.add(counts, np.bincount(c * BINS + bins, minlength=n * BINS), out=counts)
        counts = counts.reshape(n, BINS)
        above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts  # in higher bins
        r, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_pydict({"q": pa.array(r), "bin": pa.array(b), "n": pa.array(counts[r, b])})

    return run


def _reach(ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
    def best(c, v, s):
        at = np.lexsort((v, -s, c))
        c, v, s = c[at], v[at], s[at]
        first = np.searchsorted(c, c)
        keep = np.arange(len(c)) - first < k
        return c[keep], v[keep], s[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64),) * 3
        for own, s in _scored(batches, ids, q):
            r, c = np.nonzero((s >= least[None, :]) & (s > np.iinfo(np.int64).min))
            kept = best(*(np.concatenate(x) for x in zip(kept, (c, own[r], s[r, c]), strict=True)))
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[kept[0]]), "vec_id": pa.array(kept[1]), "score": pa.array(kept[2])})

    return run


def exact_topk(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k best candidates of each row of `queries`."""
    spark = df.sparkSession
    vectors, wanted = _vectors(df, id_col, vector_col), _vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    norm = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    folder = f"{shared_folder(spark)}/topk-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    if norm is None:  # no candidates
        return spark.read.schema(schema).parquet(folder)

    def answer(rows: list) -> None:
        ids, q = np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64).reshape(len(rows), -1)
        bound = np.ceil(np.sqrt((q * q).sum(1)) * norm**0.5).astype(np.int64) + 1
        low, width = -bound, -(-(2 * bound + 1) // BINS)
        while True:
            counts = vectors.mapInArrow(_histogram(ids, q, low, width, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("q").orderBy(F.desc("bin"))
            total = F.sum("n").over(down)
            # One row for each query at most: the bin that holds its kth score.
            kth = counts.select("q", "bin", "n", total.alias("upto")).where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).collect()
            least = np.full(len(ids), np.iinfo(np.int64).min)
            for r in kth:
                least[r.q] = low[r.q] + r.bin * width[r.q]
            if (width == 1).all():
                break
            # Where fewer than k candidates exist all of them are wanted and nothing is to be refined.
            low, width = np.where(least == np.iinfo(np.int64).min, low, least), np.where(least == np.iinfo(np.int64).min, 1, -(-width // BINS))
        reached = vectors.mapInArrow(_reach(ids, q, least, k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        reached.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k).write.mode("append").parquet(folder)

    waiting: dict[int, list] = {}
    for row in wanted.orderBy("id").toLocalIterator():
        rows = waiting.setdefault(len(row.v), [])
        rows.append(row)
        if len(rows) >= block:
            answer(waiting.pop(len(row.v)))
    for rows in waiting.values():
        answer(rows)
    return spark.read.schema(schema).parquet(folder)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result: the 5 best of all `embeddings` for those whose vec_id is divisible by 50."""
    vectors = load(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
