"""Hard-negative mining over k-means inverted lists with stored centroid radii.

`build` fits centroids by Spark's k-means on a sample (about `per_list` rows for each list, chosen by a hash
of the id), then puts every row into the list of its nearest centroid and stores each list's radius, the
largest distance of its rows. By Cauchy-Schwarz the score of an anchor q with any row of a list with
centroid c and radius r lies within q.c - |q|r and q.c + |q|r, whatever the sample was.

`search` answers what anchors want: for each the k best rows of the same label, or of another label, with
scores in a window. An anchor visits lists in falling order of the upper bound, in rounds of 8, 32, 128 and
so on: a list is skipped where its bounds lie outside all windows, and an anchor stops where the bound falls
strictly below its kth score so far (rows as good as the kth may still win by their ids). A round is an
equi-join of visits with the blocks of lists: long lists and lists with many visitors are cut into blocks, so no
task holds a whole list, and only each block's k best go on.

Scores are integer inner products of floor(256 * x). Positives come first, their scores give the windows
(low percent of the positive's score, up to it) for the negatives.

Defined results: rows with a null id or label, or whose vector is null or holds a null or non-finite component take no
part; rows of different lengths have no score; rows that share an anchor's id count as its own and ask once
(with the least vector and label); repeated rows are candidates each, ties go to the smaller id; a positive with
a negative score has no negatives; an empty table gives no rows; a score beyond 63 bits is an error; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import collect_bounded, hash64, load, small, stored

#: At most so many lists; the centroids are sent to tasks.
MOST_LISTS = 4096
#: Lists that an anchor visits in the first round, and the factor by which later rounds grow.
FIRST, GROWTH = 8, 4
#: Anchors of a block.
ANCHORS = 1024


@dataclass(frozen=True)
class Index:
    """rows (cluster, spread, id, label, v) as stored files; sizes (cluster, n); centroids and radii by cluster from 0.

    Rows of another length than the centroids' are in a list of their own for each length, -1 - length.
    """

    rows: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    block: int


def whole_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    floored = F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    return df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), floored.alias("v"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    edges = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _assign(centroids: np.ndarray):
    dim = centroids.shape[1]
    half = (centroids**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            rows = _lists(batch.column(2))
            size = np.array([len(x) for x in rows], np.int64)
            cluster, far = -1 - size, np.array([float(np.sqrt(x @ x)) for x in rows])
            for i in range(0, len(rows), 4096):
                at = i + np.flatnonzero(size[i : i + 4096] == dim)
                if len(at):
                    x = np.stack([rows[j] for j in at])
                    cluster[at] = (x @ centroids.T - half).argmax(1)
                    far[at] = np.sqrt(((x - centroids[cluster[at]]) ** 2).sum(1))
            # Deals a list's rows over its blocks; equal in a task that runs again, as it reads the same rows.
            spread = (seen + np.arange(len(rows), dtype=np.int64)) * 7919 + part * 104729
            seen += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(spread), pa.array(far), *batch.columns], names=["cluster", "spread", "far", *batch.schema.names])

    return run


def build(rows: DataFrame, lists: int | None = None, per_list: int = 64, block: int | None = None) -> Index | None:
    """The index of `rows` (id, label, v); None if there are no rows. `lists` defaults to the square root of their number."""
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    k = max(2, min(MOST_LISTS, lists or round(common.n**0.5)))
    share = min(1.0, per_list * k / common.n)
    sample = rows.where((F.size("v") == common.dim) & (hash64(F.col("id")) < int(share * (1 << 60)))).select(array_to_vector("v").alias("features"))
    if common.dim == 0 or sample.isEmpty():
        centroids = np.zeros((1, common.dim))
    else:
        centroids = np.array(KMeans(k=k, maxIter=4, seed=13, initMode="random").fit(sample).clusterCenters())
    kept = stored(rows.mapInArrow(_assign(centroids), "cluster long, spread long, far double, id long, label long, v array<double>"))
    stats = stored(kept.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")))
    radii = np.full(len(centroids), -np.inf)
    for r in collect_bounded(stats.where("cluster >= 0"), MOST_LISTS, "lists of the index"):
        radii[r.cluster] = r.far
    return Index(kept.drop("far"), stats.select("cluster", "n"), centroids, radii, block or min(8192, max(512, common.n // 4096)))


def _visits(index: Index, first: int, last: int):
    """For anchors with their wants (array of want, low, high): the lists from place `first` to `last` in the order of the bound that may hold a wanted row."""
    centroids, radii = index.centroids, index.radii
    dim, norm = centroids.shape[1], np.sqrt((centroids**2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, cluster = [], []
            for i, (q, wants) in enumerate(zip(_lists(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                if len(q) != dim:
                    if first == 0:
                        anchor.append([i])
                        cluster.append([-1 - len(q)])
                    continue
                long = float(np.sqrt(q @ q))
                middle, slack = centroids @ q, 1e-9 * (1 + long * (norm + np.maximum(radii, 0)))
                upper, lower = middle + long * radii + slack, middle - long * radii - slack
                place = np.argsort(-upper, kind="stable")[first:last]
                fits = np.zeros(len(place), bool)
                for w in wants:
                    fits |= ~((upper[place] < w["low"]) | (lower[place] > w["high"]))
                place = place[fits & (radii[place] > -np.inf)]
                anchor.append(np.full(len(place), i))
                cluster.append(place)
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *anchor]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *cluster]).astype(np.int64)), *[c.take(at) for c in batch.columns]], names=["cluster", *batch.schema.names])

    return run


def inner_products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer scores of the rows of `c` with those of `q`."""
    top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if top < 2.0**53:
        return (c @ q.T).astype(np.int64)
    if top < 2.0**62:
        return c.astype(np.int64) @ q.astype(np.int64).T
    raise ArithmeticError("a score may exceed 63 bits")


HITS = pa.schema([("anchor", pa.int64()), ("want", pa.int32()), ("found", pa.int64()), ("score", pa.int64())])


def _best(k: int, same_label: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return HITS.empty_table()
        anchors, rows = left["id"].to_numpy(), right["id"].to_numpy()
        q, c = (np.stack(_lists(t["v"].combine_chunks())) for t in (left, right))
        scores = inner_products(c, q)
        fits = (right["label"].to_numpy()[:, None] == left["label"].to_numpy()[None, :]) == same_label
        fits &= rows[:, None] != anchors[None, :]
        wants = left["wants"].to_pylist()
        out: list[tuple[np.ndarray, ...]] = []
        for j in range(max(map(len, wants))):
            mine = [w[j] if j < len(w) else {"want": -1, "low": 1, "high": 0} for w in wants]
            low, high = (np.array([w[x] for w in mine], np.int64) for x in ("low", "high"))
            r, a = np.nonzero(fits & (scores >= low[None, :]) & (scores <= high[None, :]))
            s = scores[r, a]
            order = np.lexsort((rows[r], -s, a))
            r, a, s = r[order], a[order], s[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append((anchors[a[keep]], np.array([w["want"] for w in mine], np.int32)[a[keep]], rows[r[keep]], s[keep]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=HITS)

    return run


def search(index: Index, anchors: DataFrame, wants: DataFrame, k: int, same_label: bool) -> DataFrame:
    """anchor, want, rank (from 1), found, score: for each want (id, want, low, high) of `anchors` (id, label, v) its k best rows with scores from low to high."""
    best = None
    first, last = 0, FIRST
    while first < max(1, len(index.centroids)):
        now = wants
        if best is not None:
            kth = best.groupBy(F.col("anchor").alias("id"), "want").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth")).where(F.col("_n") >= k)
            now = wants.join(kth, ["id", "want"], "left").select("id", "want", F.greatest("low", "_kth").alias("low"), "high")
        asked = anchors.join(now.groupBy("id").agg(F.collect_list(F.struct("want", "low", "high")).alias("wants")), "id").select("id", "label", "v", "wants")
        visits = stored(asked.mapInArrow(_visits(index, first, last), "cluster long, id long, label long, v array<double>, wants array<struct<want:int,low:long,high:long>>"))
        # Lists times blocks of their rows times blocks of their visitors.
        cuts = visits.groupBy("cluster").agg(F.count(F.lit(1)).alias("_visits")).join(index.sizes, "cluster")
        cuts = small(stored(cuts.select("cluster", F.ceil(F.col("n") / index.block).alias("_rows"), F.ceil(F.col("_visits") / ANCHORS).alias("_anchors"))))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        left = visits.join(cuts, "cluster").withColumn("part", F.explode(F.transform(upto("_rows"), lambda b: b + F.col("_rows") * F.pmod(F.xxhash64("id"), "_anchors"))))
        right = index.rows.join(cuts, "cluster").withColumn("part", F.explode(F.transform(upto("_anchors"), lambda a: F.pmod("spread", "_rows") + F.col("_rows") * a)))
        pairs = left.select("cluster", "part", "id", "label", "v", "wants").groupBy("cluster", "part").cogroup(right.select("cluster", "part", "id", "label", "v").groupBy("cluster", "part"))
        hits = pairs.applyInArrow(_best(k, same_label), "anchor long, want int, found long, score long")
        if best is not None:
            hits = hits.unionByName(best.drop("rank"))
        rank = F.row_number().over(Window.partitionBy("anchor", "want").orderBy(F.desc("score"), "found"))
        best = stored(hits.withColumn("rank", rank).where(F.col("rank") <= k))
        first, last = last, last + (last - first) * GROWTH
    return best.select("anchor", "want", "rank", "found", "score")


def hard_negatives(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", lists: int | None = None, block: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best rows of the same label the best rows of other labels that score at least `percent` of the positive, and at most as much."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = whole_rows(df, id_col, label_col, vector_col)
    index = build(rows, lists, block=block)
    asked = stored(whole_rows(anchors, id_col, label_col, vector_col).groupBy("id").agg(F.min(F.struct("v", "label")).alias("_least")).select("id", "_least.label", "_least.v"))
    if index is None or asked.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    least, most = -(1 << 63), (1 << 63) - 1
    near = search(index, asked, asked.select("id", F.lit(0).alias("want"), F.lit(least).alias("low"), F.lit(most).alias("high")), positives, True)
    near = near.select(F.col("anchor").alias("id"), F.col("rank").alias("want"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * percent / 100).cast("long")
    hard = search(index, asked, near.select("id", "want", low.alias("low"), F.col("positive_score").alias("high")), negatives, False)
    return hard.withColumnRenamed("anchor", "id").join(near, ["id", "want"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's negatives of every anchor of `embeddings`."""
    rows = load(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
           FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5
"""
