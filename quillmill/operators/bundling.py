"""Pairwise bundling of codes, mutually exclusive groups, payment of multiple procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered_pairs(codes: DataFrame, pairs: DataFrame, case: str) -> DataFrame:
    """(case, primary, secondary, ...) for pairs of which a case has both codes. Equi-joins only; codes stay put."""
    a, b = codes.select(case, F.col("code").alias("primary")), codes.select(case, F.col("code").alias("secondary"))
    return a.join(F.broadcast(pairs), "primary").join(b, [case, "secondary"])


def drop_bundled(codes: DataFrame, pairs: DataFrame, case: str) -> DataFrame:
    """Every code with bundled_into: the smallest primary present that takes it in, else null (kept). Order-free."""
    taken = ordered_pairs(codes, pairs, case).groupBy(case, F.col("secondary").alias("code")).agg(F.min("primary").alias("bundled_into"))
    return codes.join(taken, [case, "code"], "left")


def exclusive_groups(codes: DataFrame, case: str, group: str, value: str) -> DataFrame:
    """Of each exclusive group of a case only the code with the greatest value stays (ties: smaller code)."""
    w = Window.partitionBy(case, group).orderBy(F.desc(value), "code")
    return codes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def multiple_payment(codes: DataFrame, case: str, value: str, rate: float = 0.5) -> DataFrame:
    """The first by value is paid in full, the others at `rate`; amounts are rounded before they are summed."""
    w = Window.partitionBy(case).orderBy(F.desc(value), "code")
    r = F.row_number().over(w)
    return codes.withColumn("role", F.when(r == 1, "primary").otherwise("secondary")).withColumn("allowed", F.when(r == 1, F.col(value)).otherwise(F.col(value) * rate))
