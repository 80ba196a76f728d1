"""Evaluation of cases against a gold standard, and the gates that a model has to pass.

A case's codes and flags are arrays of distinct texts; null counts as empty. Scores are column expressions, so that
cases stay where they are; the summary is one partial aggregate.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least (of the extra critical flags the greatest) observed value of each gate; the last is advice alone.
GATES = {"parse_success_rate": 0.95, "render_success_rate": 0.99, "avg_code_jaccard": 0.70, "avg_flag_f1": 0.75, "critical_extra_flag_rate": 0.03, "avg_text_similarity": 0.25}
LOWER_IS_BETTER, ADVICE = ("critical_extra_flag_rate",), ("avg_text_similarity",)


def _set(c: Column) -> Column:
    return F.coalesce(F.array_distinct(c), F.array().cast("array<string>"))


def code_jaccard(gold: Column, pred: Column) -> Column:
    """Shared of all; two empty sets agree."""
    every = F.size(F.array_union(_set(gold), _set(pred)))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(_set(gold), _set(pred))) / every)


def flag_f1(gold: Column, pred: Column) -> Column:
    """struct<f1, extra, missed>; a side without flags has full precision or recall."""
    both, extra, missed = F.size(F.array_intersect(_set(gold), _set(pred))), F.size(F.array_except(_set(pred), _set(gold))), F.size(F.array_except(_set(gold), _set(pred)))
    share = lambda other: F.when(both + other == 0, 1.0).otherwise(both / (both + other))
    precision, recall = share(extra), share(missed)
    return F.struct(F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)).alias("f1"), extra.alias("extra"), missed.alias("missed"))


def extra_critical(gold: Column, pred: Column, exact: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """Predicted flags that gold lacks and that are critical, by name or by how they begin."""
    critical = lambda f: reduce(lambda a, b: a | b, [f.startswith(p) for p in prefixes], f.isin(*exact) if exact else F.lit(False))
    return F.array_sort(F.filter(F.array_except(_set(pred), _set(gold)), critical))


def missing_sections(report: Column, headers: tuple[str, ...]) -> Column:
    """The headers that a report lacks, case apart, in their order."""
    text = F.upper(F.coalesce(report, F.lit("")))
    return F.array_compact(F.array(*[F.when(~text.contains(h.upper()), F.lit(h)) for h in headers]))


def text_similarity(reference: Column, candidate: Column) -> Column:
    """The ratio of matching blocks of both texts, whose lines are trimmed and not empty; null counts as empty."""
    lines = lambda t: "\n".join(x.strip() for x in (t or "").splitlines() if x.strip())

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([SequenceMatcher(None, lines(x), lines(y)).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(reference, candidate)


def f1_scores(rows: DataFrame, label: str, gold: str, pred: str) -> DataFrame:
    """micro_f1, macro_f1 (over labels that gold has) and labels of rows (label, gold boolean, pred boolean)."""
    both, extra, missed = (F.count_if(c) for c in (F.col(gold) & F.col(pred), ~F.col(gold) & F.col(pred), F.col(gold) & ~F.col(pred)))
    each = rows.groupBy(label).agg(both.alias("tp"), extra.alias("fp"), missed.alias("fn"))
    f1 = lambda tp, fp, fn: F.when(F.coalesce(2 * tp + fp + fn, F.lit(0)) == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return each.agg(f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("micro_f1"), F.coalesce(F.avg(F.when(tp + fn > 0, f1(tp, fp, fn))), F.lit(0.0)).alias("macro_f1"), F.count_if(tp + fn > 0).alias("labels"))


def gates(summary: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """gate, observed, threshold, passed, advice of a summary's one row of columns named as gates; what it lacks counts as 0."""
    thresholds = thresholds or GATES
    seen = lambda g: F.coalesce(F.col(g).cast("double"), F.lit(0.0)) if g in summary.columns else F.lit(0.0)
    one = lambda g, t: F.struct(F.lit(g).alias("gate"), F.round(seen(g), 4).alias("observed"), F.lit(t).alias("threshold"), (seen(g) <= t if g in LOWER_IS_BETTER else seen(g) >= t).alias("passed"), F.lit(g in ADVICE).alias("advice"))
    return summary.select(F.inline(F.array(*[one(g, t) for g, t in thresholds.items()])))
