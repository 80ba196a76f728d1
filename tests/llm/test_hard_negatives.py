"""op13: hard negatives against scoring every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import hard_negatives as H


def expected(rows, is_anchor, k=5, percent=80):
    whole = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked: dict = {}
    for i, y, v in whole:
        if is_anchor(i):
            asked[i] = min(asked.get(i, (v, y)), (v, y))
    out = []
    for a, (q, label) in asked.items():
        scored = [(-sum(x * z for x, z in zip(q, v, strict=True)), i, y) for i, y, v in whole if i != a and len(v) == len(q)]
        for p, pid, _ in sorted((x for x in scored if x[2] == label), key=lambda x: x[:2])[:k]:
            fits = sorted((s, i) for s, i, y in scored if y != label and percent * -p <= 100 * -s <= 100 * -p)
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i) in enumerate(fits[:k], 1)]
    return sorted(out)


def made(seed, n=300, dim=6):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    f = lambda x: float(round(x * 64) / 64)  # noqa: E731  exact in 32 bits
    rows = [(i, r.randrange(3), [f(c + r.gauss(0, 0.2)) for c in r.choice(centre)]) for i in range(n)]
    rows += [(n + i, r.randrange(2), rows[8][2]) for i in range(120)]  # a group of equal vectors
    rows += [(20, 1, rows[20][2]), (20, 2, rows[21][2]), (31, 0, rows[31][2])]  # ids that repeat
    rows += [(None, 1, rows[0][2]), (500, None, rows[0][2]), (510, 1, None), (520, 1, [1.0, float("nan")] * 3), (530, 1, [None] * dim), (540, 1, [float("inf")] * dim)]
    rows += [(600 + 10 * i, i % 2, [1.0, 0.5, f(r.random())]) for i in range(12)] + [(900, 1, []), (910, 2, []), (920, 1, [])]  # other lengths
    return rows + [(930 + i, i % 2, [0.0] * dim) for i in range(8)]


SCHEMA = "vec_id long, label int, embedding array<float>, id string, cluster int"


@pytest.mark.parametrize("seed,lists,block", [(0, None, None), (1, 5, 40), (2, 40, 16)])
def test_equals_all_pairs(spark, monkeypatch, seed, lists, block):
    monkeypatch.setattr(H, "FIRST", 2)
    monkeypatch.setattr(H, "ANCHORS", 7)
    df = spark.createDataFrame([(*x, "x", 1) for x in made(seed)], SCHEMA).repartition(5)
    got = H.hard_negatives(df, df.where(F.col("vec_id") % 10 == 0), lists=lists, block=block)
    want = expected(made(seed), lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_radii_hold_every_row(spark):
    import numpy as np

    rows = H.whole_rows(spark.createDataFrame([(*x, "x", 1) for x in made(3)], SCHEMA), "vec_id", "label", "embedding")
    index = H.build(rows, lists=6)
    kept = index.rows.collect()
    assert len(kept) == rows.count()
    for r in kept:
        if r.cluster >= 0:
            assert np.linalg.norm(np.array(r.v) - index.centroids[r.cluster]) <= index.radii[r.cluster] * (1 + 1e-12)
        else:
            assert r.cluster == -1 - len(r.v)


def test_skips_lists_outside_the_window_and_below_the_kth_score(spark):
    """Two far groups: an anchor of one doesn't visit the other."""
    r = random.Random(5)
    rows = [(i, i % 2, [float(10 * (i % 4 < 2)) + r.random() / 8, float(10 * (i % 4 > 1)) + r.random() / 8]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    index = H.build(H.whole_rows(df, "vec_id", "label", "embedding"), lists=8)
    asked = H.whole_rows(df.where("vec_id < 4"), "vec_id", "label", "embedding")
    wants = asked.select("*", F.array(F.struct(F.lit(0).alias("want"), F.lit(256 * 256 * 90).cast("long").alias("low"), F.lit(1 << 62).cast("long").alias("high"))).alias("wants"))
    visits = wants.mapInArrow(H._visits(index, 0, 8), "cluster long, id long, label long, v array<double>, wants array<struct<want:int,low:long,high:long>>").groupBy("id").count().collect()
    assert len(visits) == 4 and all(v["count"] < len(index.centroids) for v in visits)


def test_op13_equals_its_contract(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, r.choice([None, *range(10)]), [r.gauss(0, 0.125) for _ in range(8)] if i % 41 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = H.op13_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    changed = [(i, (y + 1) % 10 if y is not None and i % 7 == 0 else y, v) for i, y, v in rows]
    assert sorted(map(tuple, got.collect())) == expected(changed, lambda i: i % 100 == 0)


def test_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    one = spark.createDataFrame([(1, 1, [1.0])], none.schema)
    assert H.hard_negatives(none, none).count() == H.hard_negatives(one, none).count() == H.hard_negatives(none, one).count() == H.hard_negatives(one, one).count() == 0
