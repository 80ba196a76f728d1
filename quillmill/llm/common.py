"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the operators' contracts: 0x20 and 0x09 to 0x0D.
SPACES = rb" \t\n\v\f\r"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset, as in tests, a folder of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, which outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpoint(), but as a Parquet table in the shared folder, which is compressed; for larger results."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size has a bound by construction; it is checked, not trusted."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: over {limit} rows")
    return rows


def hash64(*cols: Column) -> Column:
    """60 bits of md5 as a non-negative long: evenly spread, and the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])), 1, 15), 16, 10).cast("long")


#: Up to so many rows (of 60 bytes or so) are sent to every task instead of shuffling texts; counted first.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed or stored table for the small side of a join: broadcast where its count allows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def row_hash(text: Column) -> Column:
    """With the id it tells rows of different texts apart, where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the rows that `decided` (_id, _hash, _keep) drops; rows it doesn't name stay.

    Rows are known by id, null too, and row_hash. Where several rows share both and are to stay, the one
    that is least in all its columns does.
    """
    same = lambda df, other: df[id_col].eqNullSafe(other["_id"]) & (row_hash(df[text_col]) == other["_hash"])
    gone = decided.where(~F.col("_keep")).select("_id", "_hash").distinct()
    gone = small(checkpoint(gone.select(F.col("_id").alias("_gone_id"), F.col("_hash").alias("_gone_hash"))))
    left = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (row_hash(docs[text_col]) == gone["_gone_hash"]), "left_anti")
    again = checkpoint(decided.where("_keep").groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id", "_hash"))
    if again.isEmpty():
        return left
    one = left.join(again, same(left, again), "left_semi").groupBy(F.col(id_col).alias("_i"), row_hash(F.col(text_col)).alias("_t")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return left.join(again, same(left, again), "left_anti").unionByName(one.select("_row.*"))


def gapless_rank(df: DataFrame, key: str, order: list[Column], out: str, per_bucket: int = 5_000, total: int | None = None) -> DataFrame:
    """Numbers the rows of each key from 0 by `order`, whose first column is a long in [0, 2**60).

    No task sees a whole key: rows are numbered inside (key, range of the first order column), and the
    ranges' starting numbers are prefix sums over a table of counts. The number of ranges follows the
    number of rows, so a key with a third of all rows is spread like any other.
    """
    buckets = max(1, -(-(df.count() if total is None else total) // per_bucket))
    width = (1 << 60) // buckets + 1
    cut = df.withColumn("_bucket", F.floor(order[0] / F.lit(width)).cast("long"))
    counts = cut.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1)
    joined = local.join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, (F.col("_base") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_key", "_b", "_base")
