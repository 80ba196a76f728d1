"""A vault of personal data: authenticated encryption with key ids, rotation and an append-only audit of reads.

Values are sealed by AES-GCM with their id as additional data, so that a sealed value can't be moved to another
id. Keys are a small table (key_id, key), joined by id; a wrong or missing key gives null. The audit says who read
which ids when and why, never what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = "key_id string, key binary"
#: Most keys; the table is sent to all tasks.
MOST_KEYS = 10_000


def _keys(keys: DataFrame) -> DataFrame:
    if keys.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"over {MOST_KEYS} keys")
    return F.broadcast(keys.select(F.col("key_id").alias("_key_id"), F.col("key").alias("_key")))


def sealed(df: DataFrame, id_col: str, value_col: str, keys: DataFrame, key_id: str) -> DataFrame:
    """id, key_id, sealed (binary). Null values stay null; without the key there are no rows but an error."""
    one = _keys(keys.where(F.col("key_id") == key_id))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(value_col).cast("string").alias("_value"), F.lit(key_id).alias("key_id")).join(one, F.col("key_id") == F.col("_key_id"), "left")
    key = F.when(F.col("_key").isNull(), F.raise_error(F.lit(f"no key {key_id}")).cast("binary")).otherwise(F.col("_key"))
    return rows.select("id", "key_id", F.aes_encrypt("_value", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.coalesce("id", F.lit("")).cast("binary")).alias("sealed"))


def opened(vault: DataFrame, keys: DataFrame) -> DataFrame:
    """id, key_id, value; null where the key is missing or another's, or the id isn't the one sealed with."""
    rows = vault.join(_keys(keys), F.col("key_id") == F.col("_key_id"), "left")
    value = F.try_aes_decrypt("sealed", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.coalesce("id", F.lit("")).cast("binary"))
    return rows.select("id", "key_id", F.when(F.col("_key").isNotNull(), value).cast("string").alias("value"))


def rotated(vault: DataFrame, keys: DataFrame, key_id: str) -> DataFrame:
    """The vault with all values that can be opened sealed under another key; what can't stays as it is."""
    plain = opened(vault, keys).withColumnRenamed("key_id", "_old")
    old = vault.select(F.col("id").alias("_id"), F.col("key_id").alias("_old_id"), F.col("sealed").alias("_sealed"))
    new = sealed(plain.where("value IS NOT NULL"), "id", "value", keys, key_id)
    done = plain.where("value IS NOT NULL").select("id").distinct()
    rest = old.join(done, old["_id"].eqNullSafe(done["id"]), "left_anti").select(F.col("_id").alias("id"), F.col("_old_id").alias("key_id"), F.col("_sealed").alias("sealed"))
    return new.unionByName(rest)


def audited(rows: DataFrame, path: str, who: str, why: str, at: Column | None = None) -> DataFrame:
    """`rows` (id, value), once their ids are appended to the audit: a failed audit opens nothing."""
    seen = rows.select("id", F.lit(who).alias("who"), F.lit(why).alias("why"), (at if at is not None else F.current_timestamp()).alias("at"), F.col("value").isNotNull().alias("opened"))
    seen.write.mode("append").parquet(path)
    return rows
