"""Splits of multi-label rows that keep each label's and each pair of labels' shares, with groups whole.

Rows of a group are one unit: its labels are those of all its rows, its weight their number. Units come in
the order of their rarest label, then of their rarest pair of labels (order 2), so that what is rare is dealt
first and side by side, then by all labels with their rows, and a hash of the group. A unit goes to the
split that the golden-ratio sequence gives at its place, the weight of all units before it: any stretch of that
order, and so any rare pair, is split in the shares to within a few rows.

Places are prefix sums: the order is cut into ranges, and only the ranges' weights meet in one task. Nothing goes
through the driver and no label's rows meet in one task, however common.

A null group is a group of its own for each row; null and empty label arrays are units without labels; an empty table has no units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.sources.shared import stored

#: 2**31 over the golden ratio: multiples of it, modulo 2**31, are spread evenly.
GOLDEN, CIRCLE = 1327217885, 1 << 31


def running_weight(df: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """The sum of `weight` over all rows before a row, in an order that is total."""
    cut = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = cut.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))  # a row for each range
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(base), "_range").withColumn(out, F.col("_base") + F.col("_inside")).drop("_range", "_inside", "_base")


def units(df: DataFrame, group: str, labels: str) -> DataFrame:
    """unit (the group), labels (distinct, in order), set (labels with the number of rows that have them), weight of each group."""
    weights = df.groupBy(F.col(group).alias("unit")).agg(F.count(F.lit(1)).alias("weight"))
    rows = df.select(F.col(group).alias("unit"), F.explode(F.array_distinct(labels)).alias("label")).where("label IS NOT NULL")
    own = rows.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("own"))
    text = F.array_join(F.transform("own", lambda x: F.concat_ws(":", x["label"], x["n"].cast("string"))), "\t")
    none = F.array().cast("array<string>")
    return weights.join(own, "unit", "left").select("unit", F.coalesce(F.transform("own", lambda x: x["label"]), none).alias("labels"), F.coalesce(text, F.lit("")).alias("set"), "weight")


def _rarest(units: DataFrame, of: Column, name: str) -> DataFrame:
    """`units` with the rarest of an array of texts ("" where it is empty) and the number of units that have it."""
    own = units.columns
    each = stored(units.select("*", F.explode_outer(of).alias("_one")))
    n = each.groupBy("_one").agg(F.count(F.lit(1)).alias("_n"))
    best = each.join(n, "_one", "left").groupBy(*own).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_one", F.lit("")).alias("one"))).alias("_best"))
    return best.select(*own, F.col("_best.one").alias(name), F.col("_best.n").alias(f"{name}_n"))


def by_rarity(units: DataFrame) -> DataFrame:
    """`units` with their rarest label and rarest pair of labels (parted by a tab), each with its number of units."""
    pairs = F.flatten(F.transform("labels", lambda a: F.transform(F.filter("labels", lambda b: b > a), lambda b: F.concat_ws("\t", a, b))))
    return _rarest(_rarest(units, F.col("labels"), "label"), pairs, "pair")


def stratified_split(df: DataFrame, group: str, labels: str, shares: dict[str, float]) -> DataFrame:
    """`df` with a column `split`, one of the names of `shares`, whose values sum to 1."""
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares don't sum to 1")
    taken = {"_unit", "_split_of", "split"} & set(df.columns)
    if taken:
        raise ValueError(f"columns are taken: {sorted(taken)}")
    # A row without a group is one by itself.
    named = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("r"), F.xxhash64(*df.columns).cast("string"), F.lit(":"), F.monotonically_increasing_id().cast("string")))
    rows = stored(df.withColumn("_unit", named))
    order = by_rarity(units(rows, "_unit", labels)).withColumn("_hash", F.md5("unit"))
    placed = running_weight(order, ["label_n", "label", "pair_n", "pair", "set", "_hash", "unit"], "weight", "place")
    at, upto, split = F.pmod(F.pmod("place", F.lit(CIRCLE)) * F.lit(GOLDEN), F.lit(CIRCLE)), 0.0, None
    for name, share in list(shares.items())[:-1]:
        upto += share
        split = F.when(at < int(upto * CIRCLE), name) if split is None else split.when(at < int(upto * CIRCLE), name)
    last = list(shares)[-1]
    split = F.lit(last) if split is None else split.otherwise(last)
    dealt = placed.select(F.col("unit").alias("_split_of"), split.alias("split"))
    return rows.join(dealt, F.col("_unit") == F.col("_split_of")).drop("_unit", "_split_of")
