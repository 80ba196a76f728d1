"""Exact dedup by skew-safe combining.

Texts are equal when their normal forms (each run of white space one space) are identical.
1. Locally: a partial aggregate keeps one row for each distinct text of a partition, before any shuffle.
2. Salted: rows meet by (digest, text, salt); the salt is the partition, folded into `salts`, so copies
   of one text spread over that many tasks.
3. Globally: the salts' winners meet by (digest, text).
Every grouping has the whole normal form in its key, so digests only route rows: two texts with equal
digests stay apart. Rows then find their winner by digest. A digest with several texts (which SHA-256
doesn't produce in practice, and a test makes with a weak digest) has its rows joined by whole text.

Defined results: null text counts as empty and so equals it and nothing else; of equal texts the
smallest id stays, ids that are null last; of rows equal in text and id each is returned, and `kept` is
true for all rows that carry keep_id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import checkpoint, keep_rows, load, row_hash


def normal_form(text: Column) -> Column:
    """Every run of [\\x20\\x09-\\x0D] as one space; lone spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _grouped(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    """One row per row of `docs`: _id, _hash, _digest, and of its group `stays` (of the row that does) and group_size."""
    rows = docs.select(F.col(id_col).alias("_id"), row_hash(F.col(text_col)).alias("_hash"), normal_form(F.col(text_col)).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("_digest", "_text", "_salt").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("_n"))
    winners = salted.groupBy("_digest", "_text").agg(F.min("_least").alias("stays"), F.sum("_n").alias("group_size"))
    # The text travels on only where a digest has several texts.
    routed = winners.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.min("stays").alias("stays"), F.sum("group_size").alias("group_size"))
    routed = checkpoint(routed)
    lone, out = routed.where("_texts = 1").drop("_texts"), ["_id", "_hash", "_digest", "stays", "group_size"]
    # Groups over a thousandth of all rows are fewer than a thousand: their winners go to every task, so
    # that no task meets a whole one of them.
    total = routed.agg(F.sum("group_size")).first()[0] or 0
    large = lone.where(F.col("group_size") * 1000 > total)
    # Both sides of the split read this; written once, the texts aren't hashed again for the second.
    keyed = checkpoint(rows.select("_id", "_hash", "_digest").join(F.broadcast(large), "_digest", "left"))
    small = keyed.where("stays IS NULL").drop("stays", "group_size").join(lone.where(F.col("group_size") * 1000 <= total), "_digest")
    found = keyed.where("stays IS NOT NULL").select(out).unionByName(small.select(out))
    shared = routed.where("_texts > 1").select("_digest")
    if not shared.isEmpty():
        apart = rows.join(shared, "_digest").join(winners.join(shared, "_digest"), ["_digest", "_text"])
        found = found.unionByName(apart.select(out))
    return found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per row of `docs`: the id, keep_id, group_size, kept, text_sha256."""
    df = _grouped(docs, id_col, text_col, salts, digest)
    kept = F.col("_id").eqNullSafe(F.col("stays.id"))
    return df.select(F.col("_id").alias(id_col), F.col("stays.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """The rows of `docs` that stay, with their columns: one for each distinct text, whatever ids repeat or lack."""
    groups = _grouped(docs, id_col, text_col, salts, digest).where("group_size > 1")
    stays = F.col("_id").eqNullSafe(F.col("stays.id")) & (F.col("_hash") == F.col("stays.hash"))
    return keep_rows(docs, checkpoint(groups.select("_id", "_hash", stays.alias("_keep"))), id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's result over all of `documents`."""
    return exact_groups(load(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
