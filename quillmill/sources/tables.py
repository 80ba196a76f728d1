"""Scans and sinks. Every reader leaves filters and columns to the scan; nothing is read twice to infer a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column types of a directory of parquet tables, for readers that must not infer.
NOTE_SCHEMA = "note_id string, text string, meta string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: its path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_notes(spark: SparkSession, path: str, schema: str = NOTE_SCHEMA) -> DataFrame:
    """JSON lines or documents; rows that don't parse are kept with their raw text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def labelled_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV with a header; rows that lack a required value go."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).dropna(subset=required)


def delimited_concepts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bar-delimited rows without a header."""
    return spark.read.schema(schema).option("sep", "|").csv(path)


def pages(df: DataFrame, text: str, marker: str) -> DataFrame:
    """Splits full texts on page header lines, keeping header and body: page_num, header, body; lossless."""
    heads, bodies = F.regexp_extract_all(text, F.lit(marker), F.lit(0)), F.split(text, marker, -1)
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), heads).alias("header"), bodies.alias("body"))
    return df.select("*", F.posexplode(zipped).alias("page_num", "_page")).select("*", "_page.header", "_page.body").drop("_page")


def reassemble(df: DataFrame, by: str) -> DataFrame:
    """The inverse of pages()."""
    parts = F.array_sort(F.collect_list(F.struct("page_num", F.concat("header", "body").alias("part"))))
    return df.groupBy(by).agg(F.concat_ws("", F.transform(parts, lambda p: p["part"])).alias("text"))


def upsert(base: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """`base` with the rows of `change` in place of those with equal keys."""
    return base.join(change.select(*keys), keys, "left_anti").unionByName(change)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
