"""Small cases of single operators."""

import random
import re

from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import bundling, learning, reconcile, rules, spans
from quillmill.sources import tables
from quillmill.streaming import folds


def test_spans_have_the_offsets_of_finditer(spark):
    rows = [(1, "a@b.co, x 1.2.3.4 and a@b.co"), (2, "nothing"), (3, None), (4, "")]
    found = spans.find(spark.createDataFrame(rows, "id long, text string"), "text", spans.PII, ["id"]).collect()
    expected = {(i, e, m.start(), m.end()) for i, t in rows if t for e, (p, _) in spans.PII.items() for m in re.finditer(p, t)}
    assert {(r.id, r.entity, r.start, r.end) for r in found} == expected


def test_merged_spans_are_disjoint(spark):
    r = random.Random(1)
    rows = [(i % 3, a := r.randrange(50), a + r.randrange(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, start int, end int")
    out = sorted((x.id, x.start, x.end) for x in spans.merge(df, "id").collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(out, out[1:]))
    covered = lambda xs: {(i, k) for i, s, e in xs for k in range(s, e)}
    assert covered(out) == covered(rows)


def test_last_kept_wins_by_confidence_then_length(spark):
    df = spark.createDataFrame([([(0, 5, 0.5), (3, 9, 0.9), (8, 12, 0.2), (20, 22, 0.1)],)], "s array<struct<start:int,end:int,confidence:double>>")
    out = df.select(spans.best_last_kept(F.col("s")).alias("o")).first().o
    assert [(x.start, x.end) for x in out] == [(3, 9), (20, 22)]


def test_mask_keeps_length(spark):
    df = spark.createDataFrame([("ab 123 c4",), ("",), ("999",)], "t string")
    assert [r[0] for r in df.select(T.mask(F.col("t"), "[0-9]+", "#")).collect()] == ["ab ### c#", "", "###"]


def test_rules_against_an_interpreter(spark):
    def holds(p, row):
        if "all" in p:
            return all(holds(x, row) for x in p["all"])
        if "any" in p:
            return any(holds(x, row) for x in p["any"])
        if "not" in p:
            return not holds(p["not"], row)
        v = row[p["field"]]
        op, w = next((k, x) for k, x in p.items() if k != "field")
        if op == "exists":
            return (v is not None) == w
        if op in ("gt", "gte", "lt", "lte"):
            v = 0 if v is None else v
        if v is None:
            return False
        return {"eq": v == w, "ne": v != w, "gt": op == "gt" and v > w, "gte": op == "gte" and v >= w, "lt": op == "lt" and v < w, "lte": op == "lte" and v <= w, "in": op == "in" and v in w}[op]

    r = random.Random(3)

    def made(depth):
        k = r.randrange(6 if depth else 3)
        if k < 3:
            f = r.choice("ab")
            op = r.choice(["eq", "ne", "gt", "gte", "lt", "lte", "in", "exists"])
            return {"field": f, op: [1, 2] if op == "in" else r.random() < 0.5 if op == "exists" else r.randrange(4)}
        return {"not": made(depth - 1)} if k == 3 else {"all" if k == 4 else "any": [made(depth - 1) for _ in range(2)]}

    rows = [{"a": a, "b": b} for a in (None, 0, 1, 3) for b in (None, 0, 2)]
    df = spark.createDataFrame([(i, x["a"], x["b"]) for i, x in enumerate(rows)], "i int, a int, b int")
    preds = [made(3) for _ in range(25)]
    got = {x.i: x for x in df.select("i", *[rules.compile_predicate(p).alias(f"p{k}") for k, p in enumerate(preds)]).collect()}
    for i, row in enumerate(rows):
        assert [got[i][f"p{k}"] for k in range(len(preds))] == [holds(p, row) for p in preds]


def test_rules_see_what_earlier_ones_left(spark):
    steps = [{"id": "1", "priority": 2, "needs": ["X"], "add": ["Y"], "drop": ["X"]}, {"id": "2", "priority": 1, "add": ["X"]}]
    assert spark.range(1).select(rules.apply_in_order(F.array(F.lit("A")), steps)).first()[0] == ["A", "Y"]


def test_bundling_is_idempotent(spark):
    codes = spark.createDataFrame([(1, 0), (1, 5), (1, 10), (2, 5)], "l long, code long")
    pairs = spark.createDataFrame([(0, 5), (5, 10)], "primary long, secondary long")
    once = bundling.drop_bundled(codes, pairs, "l")
    assert {(r.l, r.code, r.bundled_into) for r in once.collect()} == {(1, 0, None), (1, 5, 0), (1, 10, 5), (2, 5, None)}
    kept = once.where("bundled_into IS NULL").select("l", "code")
    assert bundling.drop_bundled(kept, pairs, "l").where("bundled_into IS NOT NULL").count() == 0


def test_empty_sets_agree_and_reliability_leaves_out_one(spark):
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(T.jaccard(empty, empty)).first()[0] == 1.0
    df = spark.createDataFrame([(0.1, 0), (0.15, 1), (1.0, 1)], "p double, y int")
    assert [(r.bin, r.n) for r in learning.reliability(df, "p", "y").collect()] == [(1, 2)]


def test_groups_keep_their_split(spark):
    df = spark.createDataFrame([(i, f"g{i % 40}") for i in range(400)], "i int, g string")
    assert df.withColumn("s", learning.split_of(F.col("g"))).groupBy("g").agg(F.count_distinct("s").alias("n")).where("n > 1").count() == 0


def test_comparison_is_symmetric(spark):
    a, b = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    assert {(r.k, r.v, r.in_a, r.in_b) for r in reconcile.compare(a, b, ["k", "v"]).collect()} == {(1, 1, True, False), (1, 2, True, True), (2, 3, False, True)}


def test_pages_are_lossless_and_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "head\n== Page 1 ==\nbody\n== Page 2 ==\nmore"), (2, "plain")], "id long, text string")
    parts = tables.pages(df, "text", r"== Page [0-9]+ ==\n")
    assert {(r.id, r.text) for r in tables.reassemble(parts, "id").collect()} == {(r.id, r.text) for r in df.collect()}
    tables.write_jsonl(df, f"{tmp_path}/j")
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.json_lines(spark, f"{tmp_path}/j", "id long, text string").count() == 2
    assert tables.labelled_csv(spark, f"{tmp_path}/c", "id long, text string", ["text"]).count() == 2
    assert tables.upsert(df, df.where("id = 2").withColumn("text", F.lit("new")), ["id"]).where("text = 'new'").count() == 1


def test_streamed_duplicates_are_dropped_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "view", 1.0)] * 2 + [(2, "2024-01-01 00:01:00", 1, "view", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = folds.event_stream(spark, f"{tmp_path}/events", df.schema, "*.parquet")
    assert folds.drained(folds.once(stream, "1 hour", "event_id"), "append", str(tmp_path)).count() == 2


def test_quote_anchor_of_few_words(spark, tmp_path):
    from quillmill.catalog import QUERIES

    spark.createDataFrame([(1, "Single"), (2, "one two"), (3, "a longest b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, "a single, here"), (8, "One twofold A longest b"), (9, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.item_id, r.doc_id, r.method, r.found_at) for r in QUERIES["quote_anchor"].run(spark, str(tmp_path)).collect())
    assert got == [(1, 7, "case", 3), (2, 8, "case", 1), (3, 8, "case", 13)]


def test_json_paths(spark):
    from quillmill.functions import json_paths as J

    rows = [(1, '{"a": {"b": 1, "c": [true, "x"]}, "d": null}'), (2, "not json"), (3, None), (4, "{}"), (5, "7")]
    got = J.leaves(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()
    assert {(r.id, r.path, r.value) for r in got} == {(1, "/a/b", "1"), (1, "/a/c/0", "true"), (1, "/a/c/1", "x"), (1, "/d", None), (5, "", "7")}

    m = F.create_map(*[F.lit(x) for x in ("/a/b", "1", "/a/c", "2", "/ab", "3")])
    one = lambda c: dict(spark.range(1).select(c.alias("m")).first().m)
    assert one(J.patch(m, [{"op": "remove", "path": "/a"}])) == {"/ab": "3"}
    assert one(J.patch(m, [{"op": "move", "from": "/a", "path": "/x/y"}])) == {"/x/y/b": "1", "/x/y/c": "2", "/ab": "3"}
    assert one(J.patch(m, [{"op": "add", "path": "/ab/z", "value": "9"}])) == {"/a/b": "1", "/a/c": "2", "/ab/z": "9"}
    whole = {"/a/b": "1", "/a/c": "2", "/ab": "3"}
    assert one(J.patch(m, [{"op": "remove", "path": "/ab"}, {"op": "test", "path": "/a/b", "value": "8"}])) == whole
    assert one(J.patch(m, [{"op": "replace", "path": "/nope", "value": "8"}])) == whole
    copied = F.create_map(*[F.lit(x) for x in ("/a", "1", "/x", "2")])
    assert one(J.patch(copied, [{"op": "copy", "from": "/x", "path": "/a/b"}])) == {"/x": "2", "/a/b": "2"}  # a leaf has nothing below it
    other = F.create_map(F.lit("/a"), F.lit("5"), F.lit("/ab"), F.lit(None).cast("string"))
    assert one(J.merge(m, other)) == {"/a": "5"}


def test_clinical_enums(spark):
    from quillmill.functions import enums

    cases = [("sedation_type", " Conscious Sedation ", "Moderate"), ("sedation_type", "MAC", "MAC"), ("airway_type", "8.0 endotracheal tube", "Tracheostomy"), ("pleural_side", "RT", "Right"),
             ("stent_type", "uncovered metal stent", "Metallic-Covered"), ("ventilation_mode", "N/A", None), ("disposition", "something else", None), ("disposition", None, None), ("final_diagnosis", "adenocarcinoma", "Malignancy")]
    for field, raw, value in cases:
        assert spark.range(1).select(enums.canonical(field, F.lit(raw).cast("string")).alias("v")).first().v == value, (field, raw)
