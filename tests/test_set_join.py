"""The Jaccard join against all pairs."""

import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from quillmill.catalog import QUERIES
from quillmill.operators.set_join import jaccard_join, near_parts


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_equals_all_pairs(spark, block):
    r = random.Random(3)
    some = lambda: r.sample("abcdefghij", r.randrange(0, 7))
    rows = [(i, some()) for i in range(60)] + [(60, None), (61, []), (None, ["a", "b"]), (3, ["a", None])]
    sets = [(f"s{i}", some()) for i in range(20)] + [("n", None), ("e", []), ("s1", ["a", "b", "c"]), ("x", [None, "a"])]
    df, other = spark.createDataFrame(rows, "id int, w array<string>").repartition(3), spark.createDataFrame(sets, "key string, w array<string>")
    want = []
    for i, x in rows:
        for k, y in sets:
            a, b = {t for t in x or [] if t}, {t for t in y or [] if t}
            if a & b and len(a & b) / len(a | b) >= 0.4:
                want.append((i, k, len(a & b), len(a & b) / len(a | b)))
    assert sorted(map(tuple, jaccard_join(df, other, 0.4, block).collect()), key=repr) == sorted(want, key=repr) and want
    assert jaccard_join(df, other.limit(0), 0.4).count() == jaccard_join(df.limit(0), other, 0.4).count() == 0


def test_near_parts_equal_all_pairs(spark):
    r = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    texts = []
    for _ in range(120):
        parts = [[r.choice(words) for _ in range(r.randrange(3, 14))] for _ in range(r.randrange(1, 12))]
        parts += [[w if r.random() > 0.12 else r.choice(words) for w in p] for p in parts]
        texts.append(". ".join(" ".join(p).capitalize() for p in parts))

    def plain(t):
        sets = [x for x in {frozenset(re.findall("[a-z]{3,}", s.lower())) for s in (t or "").split(". ")} if len(x) >= 5]
        return sum(4 * len(x & y) >= 3 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])

    rows = [(i, t) for i, t in enumerate([*texts, None, "", "a b. c", texts[0] + ". " + texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", near_parts(F.lower("text"), ". ", "[a-z]{3,}", 5).alias("n"))
    got = {x.doc_id: x.n for x in df.collect()}
    assert got == {i: plain(t) for i, t in rows} and sum(got.values()) > 100


def test_near_dup_lines_shuffles_nothing(spark, capsys):
    QUERIES["near_dup_lines"].run(spark, DATA).explain()
    assert "Exchange" not in capsys.readouterr().out
