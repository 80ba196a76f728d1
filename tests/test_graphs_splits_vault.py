"""Cycles against a search of all paths, splits by their shares, the vault by what its files and keys give away."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import cycles as C
from quillmill.operators import stratify as Z
from quillmill.operators import vault as V


def all_cycles(edges, most):
    edges = {e for e in edges if None not in e}
    nodes = sorted({x for e in edges for x in e})
    return sorted(p for k in range(1, min(most, len(nodes)) + 1) for p in itertools.permutations(nodes, k) if p[0] == min(p) and all((a, b) in edges for a, b in zip(p, (*p[1:], p[0]), strict=True)))


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(7), r.randrange(7)) for _ in range(14)] + [(10, 11), (11, 12), (12, 13), (None, 1), (1, None), (3, 3), (3, 3)]
    df = spark.createDataFrame(edges, "a int, b int")
    for most in (None, 3):
        assert sorted(tuple(x.cycle) for x in C.cycles(df, most).collect()) == all_cycles(edges, most or 7)
    assert {tuple(x) for x in C.core(df).collect()} <= {e for e in edges if None not in e and max(e) < 10}
    assert C.cycles(df.where("a >= 10")).count() == C.cycles(df.limit(0)).count() == 0


def test_split_shares_of_each_label_and_whole_groups(spark):
    r = random.Random(3)
    rows = []
    for i in range(20_000):
        labels = [x for x, p in (("common", 0.9), ("half", 0.5), ("rare", 0.03), ("rarer", 0.01)) if r.random() < p]
        rows.append((i // 4 if i % 50 else None, labels if i % 97 else None, i))
    df = spark.createDataFrame(rows, "visit int, tags array<string>, weight int")
    shares = {"train": 0.7, "test": 0.2, "held": 0.1}
    got = [tuple(x) for x in Z.stratified_split(df, "visit", "tags", shares).select("visit", "tags", "weight", "split").collect()]
    assert sorted(x[2] for x in got) == list(range(20_000))
    by_group = {}
    for visit, _, _, split in got:
        if visit is not None:
            assert by_group.setdefault(visit, split) == split
    for label, slack in (("common", 0.01), ("half", 0.01), ("rare", 0.02), ("rarer", 0.04)):
        own = [x[3] for x in got if x[1] and label in x[1]]
        assert all(abs(own.count(s) / len(own) - share) < slack for s, share in shares.items()), (label, len(own), {s: own.count(s) / len(own) for s in shares})
    assert Z.stratified_split(df.limit(0), "visit", "tags", shares).count() == 0
    with pytest.raises(ValueError, match="sum"):
        Z.stratified_split(df, "visit", "tags", {"a": 0.5})


def test_split_of_single_rows_within_one_percent(spark):
    r = random.Random(4)
    rows = [(i, [x for x, p in (("a", 0.8), ("b", 0.3), ("c", 0.05)) if r.random() < p]) for i in range(20_000)]
    got = Z.stratified_split(spark.createDataFrame(rows, "id int, tags array<string>"), "id", "tags", {"train": 0.8, "test": 0.2})
    for x in got.select(F.explode("tags").alias("t"), "split").groupBy("t").agg(F.avg((F.col("split") == "train").cast("int")).alias("share")).collect():
        assert abs(x.share - 0.8) < 0.01, x


def test_vault(spark, tmp_path):
    keys = spark.createDataFrame([("a", b"0" * 16), ("b", b"1" * 32), ("wrong", b"2" * 16)], V.KEYS)
    rows = [("1", "Ann Smith"), ("2", "Ann Smith"), ("3", ""), ("4", None), (None, "Bo")]
    df = spark.createDataFrame(rows, "id string, name string")
    V.sealed(df, "id", "name", keys, "a").write.parquet(f"{tmp_path}/v")
    vault = spark.read.parquet(f"{tmp_path}/v")
    assert sorted(map(tuple, V.opened(vault, keys).collect()), key=repr) == sorted(((i, "a", n) for i, n in rows), key=repr)
    assert not any(b"Smith" in p.read_bytes() for p in tmp_path.glob("v/*"))
    assert len({bytes(x.sealed) for x in vault.where("id < 3").collect()}) == 2  # equal texts don't show
    assert V.opened(vault.withColumn("key_id", F.lit("wrong")), keys).where("value IS NOT NULL").count() == 0
    assert V.opened(vault.withColumn("key_id", F.lit("gone")), keys).where("value IS NOT NULL").count() == 0
    assert V.opened(vault.where("id = '1'").withColumn("id", F.lit("2")), keys).first().value is None  # bound to its id
    turned = V.rotated(vault, keys, "b")
    assert sorted(((x.id, x.value) for x in V.opened(turned, keys.where("key_id = 'b'")).where("value IS NOT NULL").collect()), key=repr) == sorted(((i, n) for i, n in rows if n is not None), key=repr)
    assert turned.count() == 5 and V.rotated(vault, keys.where("key_id <> 'a'"), "b").where("key_id = 'a'").count() == 5
    with pytest.raises(Exception, match="no key"):
        V.sealed(df, "id", "name", keys, "none").collect()
    for who in ("ann", "bo"):
        V.audited(V.opened(vault.where("id < 3"), keys), f"{tmp_path}/audit", who, "review")
    log = spark.read.parquet(f"{tmp_path}/audit")
    assert sorted((x.id, x.who, x.why, x.opened) for x in log.collect()) == [("1", "ann", "review", True), ("1", "bo", "review", True), ("2", "ann", "review", True), ("2", "bo", "review", True)] and "value" not in log.columns
