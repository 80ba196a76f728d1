"""A corpus pipeline of five operators; each stage's rows are written as Parquet and read again by the next.

Every stage keeps the columns of `documents` but the last, which returns op10's. Language ID drops texts
without a language, exact dedup and the n-gram join (five words, similarity 0.8) keep one document of
each group, mixing puts the rest in the order of its schedule, BPE encodes and decodes every text. `run`
adds each row's place in that order, from 0, to the result as `mixed_position`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.bpe import SMALL_MEMO, encode_decode
from quillmill.llm.common import shared_folder
from quillmill.llm.exact_dedup import drop_copies
from quillmill.llm.language_id import drop_unknown
from quillmill.llm.mixing import interleaved
from quillmill.llm.ngram_join import drop_near_copies

#: SQL can't express language ID by a trained model or the BPE merges.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return interleaved(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    if "mixed_position" not in docs.columns:
        return encode_decode(docs, path, memo=SMALL_MEMO)
    out = encode_decode(docs.select(F.struct("doc_id", "mixed_position").alias("_key"), "text"), path, id_col="_key", memo=SMALL_MEMO)  # executors are full from the stages before
    return out.select("_key.doc_id", *out.columns[1:], "_key.mixed_position")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("bpe", bpe)]


def in_written_order(docs: DataFrame) -> DataFrame:
    """`docs`, read from Parquet, with the place of each row in the files' order; a plain read packs files by size."""
    rows = docs.select("*", F.col("_metadata.file_name").alias("_mix_file"), F.col("_metadata.row_index").alias("_mix_row"))
    before = Window.orderBy("_mix_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_mix_file").agg(F.count(F.lit(1)).alias("_mix_n")).withColumn("_mix_base", F.coalesce(F.sum("_mix_n").over(before), F.lit(0)))
    placed = rows.join(F.broadcast(files), "_mix_file").withColumn("mixed_position", F.col("_mix_base") + F.col("_mix_row"))
    return placed.select(*docs.columns, "mixed_position")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "mixing":
            docs = in_written_order(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
