"""Solidity sources as tables, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of all *.sol files under folder."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sol", recursiveFileLookup=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same of files as they arrive."""
    text = spark.readStream.text(folder, wholetext=True, pathGlobFilter="*.sol", recursiveFileLookup=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def contract_names(sources: DataFrame) -> DataFrame:
    return sources.select("file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:abstract )?(?:contract|interface|library)\s+(\w+)"), F.lit(1))).alias("contract"))
