"""Table sources. Parquet reads let Catalyst prune columns and push
filters into the scan; HTML files are read whole (one row per file)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """O01 for loose files: one row per file, page_id derived from the path."""
    df = spark.read.text(path, wholetext=True)
    df = df.withColumn("url", F.input_file_name())
    return df.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))


def read_html_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Read bytes, keep only valid UTF-8 (undecodable bytes dropped).
    ``make_valid_utf8`` maps bad sequences to U+FFFD, which we then remove;
    ``valid_utf8`` keeps a flag of whether anything was dropped."""
    df = spark.read.format("binaryFile").load(path)
    raw = F.col("content").cast("string")
    return df.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"),
        F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")).alias("html"),
        F.is_valid_utf8(raw).alias("valid_utf8"))
