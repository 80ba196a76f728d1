"""Queries over labels and documents: dedup, splits, evaluation, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions.text import bucket_of
from quillmill.operators import evaluation as E
from quillmill.operators import learning as L
from quillmill.operators import reconcile as C
from quillmill.operators.calibrated import fit_calibrated
from quillmill.operators.stratify import CIRCLE, GOLDEN, stratified_split
from quillmill.plans.registry import query
from quillmill.sources.tables import table

big = lambda c: c.cast("bigint")

#: A stand-in for a model's probability: hundredths of the id's hash.
_P = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 / 100"


def _scored(spark, d):
    return table(spark, d, "labels").withColumn("p", bucket_of(F.col("doc_id"), 100) / 100)


@query("SELECT arg_max(doc_id, (prio, -doc_id)) AS doc_id, count(*) AS copies FROM (SELECT doc_id, text, CASE WHEN quality IS NOT NULL THEN 2 ELSE 1 END AS prio FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY text")
def dedup_priority(spark, d):
    both = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return L.survivors(both, F.col("k"), F.when(F.col("quality").isNotNull(), 2).otherwise(1), "doc_id")


@query("SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(md5(text)), 1, 8))::BIGINT % 100 AS b FROM documents)")
def group_split(spark, d):
    """Equal texts share a split."""
    return table(spark, d, "documents").select("doc_id", L.split_of(F.md5("text")).alias("split"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def seeded_sample(spark, d):
    """A repeatable sample: the hundred smallest hashes. The limit is the feature."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(100)


@query(f"""WITH t AS (SELECT 'quality' AS label, quality = 1 AS y, {_P} >= 0.5 AS s FROM labels UNION ALL SELECT 'toxic', toxic = 1, {_P} >= 0.5 FROM labels),
c AS (SELECT label, count(*) FILTER (y AND s) AS tp, count(*) FILTER (NOT y AND s) AS fp, count(*) FILTER (y AND NOT s) AS fn FROM t GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c""")
def prf_metrics(spark, d):
    long = _scored(spark, d).select("p", F.inline(F.array(F.struct(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("y")), F.struct(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("y")))))
    return C.prf(long, F.col("y"), F.col("p") >= 0.5, ["label"])


@query(f"SELECT floor(p * 10)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS rate FROM (SELECT {_P} AS p, quality FROM labels) WHERE p < 1 GROUP BY 1")
def reliability_curve(spark, d):
    r = L.reliability(_scored(spark, d), "p", "quality")
    return r.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


@query(f"""WITH s AS (SELECT quality = 1 AS y, {_P} AS p FROM labels), g AS (SELECT k * 0.05::DOUBLE AS t FROM range(1, 20) AS r(k)), c AS (SELECT t, count(*) FILTER (y AND p >= t) AS tp, count(*) FILTER (NOT y AND p >= t) AS fp, count(*) FILTER (y AND p < t) AS fn FROM s, g GROUP BY 1)
SELECT round(t, 2) AS threshold, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c QUALIFY row_number() OVER (ORDER BY round(2 * tp / (2 * tp + fp + fn), 6) DESC, t) = 1""")
def threshold_opt(spark, d):
    """The threshold of best F1 on a grid: one conditional aggregate for each of the 19 steps, in a single pass."""
    s, y = _scored(spark, d), F.col("quality") == 1
    grid = [k * 0.05 for k in range(1, 20)]
    n = lambda c: F.sum(c.cast("int"))
    f1 = [F.round(2 * n(y & (F.col("p") >= t)) / (2 * n(y & (F.col("p") >= t)) + n(~y & (F.col("p") >= t)) + n(y & (F.col("p") < t))), 6) for t in grid]
    best = s.agg(F.array_max(F.array(*[F.struct(v.alias("f1"), F.lit(-t).alias("t")) for v, t in zip(f1, grid, strict=True)])).alias("b"))
    return best.select(F.round(-F.col("b.t"), 2).alias("threshold"), F.col("b.f1").alias("f1"))


@query(f"SELECT CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.4 THEN 'GRAY' ELSE 'LOW' END AS difficulty, count(*) AS n FROM (SELECT {_P} AS p FROM labels) GROUP BY 1")
def difficulty_buckets(spark, d):
    return _scored(spark, d).groupBy(F.when(F.col("p") >= 0.7, "HIGH").when(F.col("p") >= 0.4, "GRAY").otherwise("LOW").alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, round(greatest(p, CASE WHEN quality = 1 THEN 0.95 ELSE 0.1 END::DOUBLE), 4) AS confidence, p BETWEEN 0.5 AND 0.9 AS review FROM (SELECT doc_id, quality, {_P} AS p FROM labels)")
def confidence_combine(spark, d):
    rule = F.when(F.col("quality") == 1, 0.95).otherwise(0.1)
    return _scored(spark, d).select("doc_id", F.round(F.greatest("p", rule), 4).alias("confidence"), F.col("p").between(0.5, 0.9).alias("review"))


@query("SELECT tag, count(*) AS cases, count(*) FILTER (NOT ok) AS failures FROM (SELECT lang AS tag, length(text) > 50 AND regexp_matches(text, '[a-z]') AS ok FROM documents) GROUP BY 1")
def expectation_eval(spark, d):
    ok = (F.length("text") > 50) & F.col("text").rlike("[a-z]")
    return table(spark, d, "documents").groupBy(F.col("lang").alias("tag")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(~ok).alias("failures"))


@query(None)
def tfidf_lr(spark, d):
    """Documents scored by a text classifier fitted to the labelled ones."""
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    model = L.text_classifier(docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id"), "text", "label")
    return model.transform(docs).select("doc_id", F.col("prediction").cast("int").alias("prediction"))


@query(f"""WITH d AS (SELECT 'g' || (doc_id // 3)::VARCHAR AS unit, list_filter(['quality=' || quality, 'toxic=' || toxic, 'lang=' || lang, 'source=' || source], lambda x: x IS NOT NULL) AS labels FROM documents JOIN labels USING (doc_id)),
w AS (SELECT unit, count(*) AS weight FROM d GROUP BY unit), c AS (SELECT unit, label, count(*) AS n FROM (SELECT unit, unnest(labels) AS label FROM d) GROUP BY ALL),
u AS (SELECT unit, list(label ORDER BY label) AS labels, string_agg(label || ':' || n, chr(9) ORDER BY label) AS own FROM c GROUP BY unit),
l AS (SELECT * FROM (SELECT unit, label, count(*) OVER (PARTITION BY label) AS label_n FROM c) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY label_n, label) = 1),
x AS (SELECT unit, unnest(flatten(list_transform(labels, lambda a: list_transform(list_filter(labels, lambda b: b > a), lambda b: a || chr(9) || b)))) AS pair FROM u),
p AS (SELECT * FROM (SELECT unit, pair, count(*) OVER (PARTITION BY pair) AS n FROM x) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n, pair) = 1),
o AS (SELECT unit, coalesce(sum(weight) OVER (ORDER BY label_n, label, n, pair, own, md5(unit), unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM w JOIN u USING (unit) JOIN l USING (unit) JOIN p USING (unit)),
s AS (SELECT unit, ((place % {CIRCLE}) * {GOLDEN}) % {CIRCLE} AS spot FROM o)
SELECT label, CASE WHEN spot < {int(0.7 * CIRCLE)} THEN 'train' WHEN spot < {int(0.85 * CIRCLE)} THEN 'test' ELSE 'held' END AS split, count(*) AS n FROM (SELECT unit, unnest(labels) AS label FROM d) JOIN s USING (unit) GROUP BY ALL""")
def stratified_labels(spark, d):
    """Documents split by their labels, languages and sources, groups of three documents whole: rows of each label in each split."""
    name = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.floor(F.col("doc_id") / 3).alias("unit_no"), F.array_compact(F.array(*map(name, ("quality", "toxic", "lang", "source")))).alias("labels"))
    split = stratified_split(rows, "unit_no", "labels", {"train": 0.7, "test": 0.15, "held": 0.15})
    return split.select(F.explode("labels").alias("label"), "split").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def calibrated_labels(spark, d):
    """Probabilities of both labels for every document, from calibrated classifiers fitted to the labelled ones."""
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    model = fit_calibrated(docs.join(labels, "doc_id"), ["quality", "toxic"])
    p = model.probabilities(docs)
    return p.select("doc_id", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query("""WITH c AS (SELECT l_orderkey, list_distinct(list(code)) AS gc, coalesce(list_distinct(list(code) FILTER (l_quantity > 4)), []) AS pc, list_distinct(list(l_returnflag || l_linestatus)) AS gf,
  coalesce(list_distinct(list(l_returnflag || CASE WHEN l_discount >= 0.10 THEN 'X' ELSE l_linestatus END) FILTER (l_tax < 0.08)), []) AS pf FROM (SELECT *, 's' || l_suppkey % 7 AS code FROM lineitem) GROUP BY 1),
n AS (SELECT *, len(list_intersect(gf, pf)) AS tp, len(pf) AS p, len(gf) AS g, len(list_intersect(gc, pc)) AS shared, len(list_distinct(list_concat(gc, pc))) AS every FROM c),
s AS (SELECT *, CASE WHEN p = 0 THEN 1.0 ELSE tp / p END AS prec, CASE WHEN g = 0 THEN 1.0 ELSE tp / g END AS rec, len(list_filter(pf, lambda f: starts_with(f, 'R') AND NOT list_contains(gf, f))) > 0 AS critical FROM n),
t AS (SELECT avg((p > 0)::INT) AS parse, avg((len(pc) > 0 AND p > 0)::INT) AS render, avg(CASE WHEN every = 0 THEN 1.0 ELSE shared / every END) AS jaccard, avg(CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END) AS f1, avg(critical::INT) AS extra FROM s),
g AS (SELECT unnest([{'gate': 'parse_success_rate', 'o': parse, 't': 0.95::DOUBLE}, {'gate': 'render_success_rate', 'o': render, 't': 0.99}, {'gate': 'avg_code_jaccard', 'o': jaccard, 't': 0.7}, {'gate': 'avg_flag_f1', 'o': f1, 't': 0.75}, {'gate': 'critical_extra_flag_rate', 'o': extra, 't': 0.03}, {'gate': 'avg_text_similarity', 'o': 0, 't': 0.25}], recursive := true) FROM t)
SELECT gate, round(o, 4) AS observed, t AS threshold, CASE WHEN gate = 'critical_extra_flag_rate' THEN o <= t ELSE o >= t END AS passed, gate = 'avg_text_similarity' AS advice FROM g""")
def promotion_gates(spark, d):
    """The gates over orders as cases: groups of suppliers as codes and line states as flags, of which a stand-in for a model misses some and makes some up."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("code"), "l_quantity", "l_tax", F.concat("l_returnflag", "l_linestatus").alias("flag"), F.concat("l_returnflag", F.when(F.col("l_discount") >= 0.10, "X").otherwise(F.col("l_linestatus"))).alias("other"))
    cases = line.groupBy("l_orderkey").agg(
        F.collect_set("code").alias("gc"), F.collect_set(F.when(F.col("l_quantity") > 4, F.col("code"))).alias("pc"), F.collect_set("flag").alias("gf"), F.collect_set(F.when(F.col("l_tax") < 0.08, F.col("other"))).alias("pf"))
    share = lambda c: F.avg(c.cast("int"))
    gf, pf = F.col("gf"), F.col("pf")
    summary = cases.agg(
        share(F.size("pf") > 0).alias("parse_success_rate"), share((F.size("pc") > 0) & (F.size("pf") > 0)).alias("render_success_rate"), F.avg(E.code_jaccard(F.col("gc"), F.col("pc"))).alias("avg_code_jaccard"),
        F.avg(E.flag_f1(gf, pf)["f1"]).alias("avg_flag_f1"), share(F.size(E.extra_critical(gf, pf, prefixes=("R",))) > 0).alias("critical_extra_flag_rate"))
    return E.gates(summary)
