"""Set reconciliation, evaluation of labels, ordered folds of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two sets of keys: in_a, in_b."""
    return a.select(*keys).distinct().withColumn("in_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("in_b", F.lit(True)), keys, "full_outer").fillna(False, ["in_a", "in_b"])


def counts(compared: DataFrame, by: str) -> DataFrame:
    """Matched, only in a, only in b, and agreement (1 where both are empty)."""
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    both = F.col("in_a") & F.col("in_b")
    out = compared.groupBy(by).agg(n(both).alias("matched"), n(F.col("in_a") & ~F.col("in_b")).alias("only_a"), n(F.col("in_b") & ~F.col("in_a")).alias("only_b"))
    return out.withColumn("agreement", F.col("matched") / (F.col("matched") + F.col("only_a") + F.col("only_b")))


def prf(df: DataFrame, truth: Column, said: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by group; 0 where a ratio has no base."""
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = df.groupBy(*by).agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def sessions(events: DataFrame, user: str, ts: str, gap_s: int) -> DataFrame:
    """Events with their user's session number, a new one after a gap of more than `gap_s` seconds."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    far = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > gap_s * 1_000_000
    return events.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def latest(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Fold of ordered events: the last value of each key and how many there were; one partial aggregate, no sort."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("last_value"), F.count(F.lit(1)).alias("version"))
