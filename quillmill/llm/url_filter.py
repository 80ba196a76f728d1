"""URL filters by association rules: Spark's FP-growth mines URL token combinations that go with a verdict.

A list of (verdict, host, path) rules judges the URLs that it fits; those URLs are the labelled ones. Each
URL becomes tokens by place (`tokens`: top label, name, labels before it, first folder, last segment's
shape, parameters and so on, one for each place, so a URL has ten at most and its combinations are
bounded). FP-growth mines combinations of tokens and a verdict that hold for `min_support` of the labelled
URLs; those whose verdict holds for `min_confidence` of the URLs with the combination stay, but for those
that a shorter one with the same verdict is as sure as. A mined rule stands in an inverted index under its rarest token, so a
URL meets only the rules of its own tokens, and each is then compared whole. The surest rule judges the URL
(ties: wider support, fewer tokens, `block`, tokens in order); a URL that no rule fits is allowed.

The main path is DataFrame code without Python workers. At most 2**10 / min_support combinations can be
frequent, which bounds the index (102,400 rules at 0.01); it is broadcast behind a count.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule of the list and
is allowed; repeated rows and null ids give a row each; without labelled URLs nothing is mined; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import load, small, stored

#: The contract's list: verdict, host, path.
LIST = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """What stands after the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host_name: Column, path_name: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; a rule fits its host and all subdomains, and paths that start with its own."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host_name == h) | host_name.endswith(f".{h}")) & path_name.startswith(p) for _, h, p in longest]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))
    return pick([h + p for _, h, p in longest]), pick([v for v, _, _ in longest])


def tokens(url: Column) -> Column:
    """The tokens of a URL, one for each place that it has."""
    labels, parts = F.filter(F.split(host(url), r"\."), lambda x: x != ""), F.filter(F.split(path(url), "/"), lambda x: x != "")
    n, last, rest = F.size(labels), F.element_at(parts, -1), F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    named = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.substring(rest, 2, F.length(rest)), "&"), lambda x: x != ""), lambda x: F.split(x, "=")[0])))
    place = {
        "scheme": F.lower(F.substring_index(url, "://", 1)),
        "top": F.when(n > 0, F.element_at(labels, -1)),
        "name": F.when(n > 1, F.get(labels, n - 2)),
        "sub": F.when(n > 2, F.get(labels, n - 3)),
        "subs": F.when(n > 3, F.array_join(F.slice(labels, 1, F.greatest(n - 3, F.lit(1))), ".")),
        "folder": F.when(F.size(parts) > 1, F.lower(parts[0])),
        "lead": F.when(F.size(parts) > 0, F.lower(F.substring(last, 1, 1))),
        "shape": F.when(F.size(parts) > 0, F.regexp_replace(F.regexp_replace(last, "[0-9]+", "0"), "[A-Za-z]{12,}", "a")),
        "names": F.when(F.size(named) > 0, F.array_join(named, "&")),
        "depth": F.concat(F.least(F.size(parts), F.lit(9)).cast("string"), F.when(path(url).endswith("/"), "/").otherwise("")),
    }
    every = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in place.items()]))
    return F.when(F.instr(url, "://") > 0, every).otherwise(F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """antecedent (tokens in order), verdict, confidence, support (both shares), key (its rarest token), of `labelled` (tokens, verdict)."""
    spark = labelled.sparkSession
    mark = "verdict="
    rows = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(rows)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    is_mark = lambda x: x.startswith(mark)
    alone = sets.where(~F.exists("items", is_mark)).select(F.col("items").alias("antecedent"), F.col("freq").alias("_with"))
    both = sets.where(F.exists("items", is_mark) & (F.size("items") > 1)).select(
        F.filter("items", lambda x: ~is_mark(x)).alias("antecedent"), F.substring(F.filter("items", is_mark)[0], len(mark) + 1, 1000).alias("verdict"), "freq")
    total = sets.where((F.size("items") == 1) & F.exists("items", is_mark)).agg(F.sum("freq")).first()[0] or 1
    sure = stored(both.join(alone, "antecedent").select("antecedent", "verdict", (F.col("freq") / F.col("_with")).alias("confidence"), (F.col("freq") / F.lit(total)).alias("support")).where(F.col("confidence") >= min_confidence))
    shorter = sure.select(F.col("antecedent").alias("_shorter"), F.col("verdict").alias("_verdict"), F.col("confidence").alias("_sure"))
    less = sure.select("*", F.explode(F.transform("antecedent", lambda t: F.array_remove(F.col("antecedent"), t))).alias("_less"))
    idle = less.join(shorter, (F.col("_less") == F.col("_shorter")) & (F.col("verdict") == F.col("_verdict")) & (F.col("_sure") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    kept = sure.join(idle, ["antecedent", "verdict"], "left_anti")
    rare = kept.select("*", F.explode("antecedent").alias("_token")).join(alone.where(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("_token"), "_with"), "_token")
    return rare.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("_with", "_token"))["_token"].alias("key"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = LIST, min_support: float = 0.01, min_confidence: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: the id, host, path, rule and verdict, mined (the tokens of the mined rule that judged it, else null), confidence."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.select("_id", host(F.col("_url")).alias("_host"), path(F.col("_url")).alias("_path"), tokens(F.col("_url")).alias("tokens"))
    rule, verdict = listed(F.col("_host"), F.col("_path"), rules)
    rows = rows.select("*", rule.alias("_rule"), verdict.alias("verdict"))
    index = small(stored(mined_rules(rows.where(F.col("_rule").isNotNull()).select("tokens", "verdict"), min_support, min_confidence)
                         .select("key", "antecedent", "confidence", "support", F.col("verdict").alias("_says"))))
    # A row's tokens stay in one task, and are one row again after a partial aggregate there.
    open_tokens = F.when(F.col("_rule").isNull(), F.col("tokens")).otherwise(F.array().cast("array<string>"))
    asked = rows.withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode_outer(open_tokens).alias("key"))
    met = asked.join(index, "key", "left").withColumn("_fits", F.col("antecedent").isNotNull() & (F.size(F.array_except("antecedent", "tokens")) == 0))
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("antecedent").alias("n"), (F.col("_says") != "block").alias("b"), F.col("antecedent").alias("mined"), F.col("_says").alias("says"))
    out = met.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("_id", "_host", "_path", "_rule", "verdict")], F.min(F.when(F.col("_fits"), order)).alias("_best"))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("verdict", "_best.says", F.lit("allow")).alias("verdict"), F.col("_best.mined").alias("mined"), (-F.col("_best.c")).alias("confidence"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's verdict of every URL of `pages`; labels are the verdicts of the contract's list."""
    return judge(load(spark, sf_dir, "pages"))
