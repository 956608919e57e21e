"""Findings as JSON, Markdown, text and SARIF: each a table of parts, so that a report of any length is written by tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def shortened(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def as_json(findings: DataFrame, *columns: str) -> DataFrame:
    """(ord, json) of each finding."""
    return findings.select("ord", F.to_json(F.struct(*columns)).alias("json"))


def summary(findings: DataFrame) -> DataFrame:
    """The summary of a report: a line for each severity, from the highest down."""
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("severity")) for i, s in enumerate(reversed(rules.SEVERITIES))))).alias("x")
    every = findings.sparkSession.range(1).select(names).select("x.*")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "severity", "left").select(F.col("i").cast("long").alias("at"), F.format_string("- %s: %d", "severity", F.coalesce("n", F.lit(0))).alias("line"))


def markdown(findings: DataFrame) -> DataFrame:
    """(ord, text): the part of a report on each finding. Columns severity, confidence, title, scanner_id, file, line."""
    where = F.format_string("- %s:%d", "file", "line")
    return findings.select("ord", F.concat(F.lit("### "), "severity", F.lit(": "), "title", F.lit("\n\n**Scanner:** "), "scanner_id", F.lit("\n**Confidence:** "), "confidence", F.lit("\n\n**Locations:**\n"), where, F.lit("\n")).alias("text"))


def by_severity(findings: DataFrame, locations: int = 3) -> DataFrame:
    """(severity, title, n, places): findings of one severity and title together, with their first places."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("turn") <= locations, F.struct("ord", "file", "line", F.concat_ws(":", "file", "line").alias("place"))))), 1, locations)
    turn = F.row_number().over(Window.partitionBy("severity", "title").orderBy("ord", "file", "line"))
    g = findings.withColumn("turn", turn).groupBy("severity", "title").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return g.select("severity", "title", "n", F.array_join(F.transform("first", lambda x: x["place"]), ", ").alias("places"))


def top_titles(findings: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` findings of the severities Critical and High."""
    return findings.where(F.col("severity").isin("Critical", "High")).orderBy("ord").limit(most).select("ord", "severity", "title")


def sarif(findings: DataFrame) -> DataFrame:
    """(ord, result): each finding as a result of SARIF 2.1.0."""
    level = F.when(F.col("severity").isin("Critical", "High"), "error").when(F.col("severity") == "Medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select("ord", F.to_json(F.struct(F.col("scanner_id").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))
