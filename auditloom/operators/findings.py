"""The findings pipeline. A finding: ord, scanner_id, severity, confidence, score, file, line, function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

BUCKET = 5


def fingerprint(file: Column, line: Column) -> tuple[Column, Column]:
    """The file without its leading folders, and the line's bucket."""
    return F.regexp_replace(file, r"^(/|\./)*(contracts/)?", ""), F.floor(line / BUCKET).cast("long")


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding of each category, file and bucket of lines: the one of the greatest score, of equals that of the lowest
    priority, of these the last.

    Within a bucket any two findings are close enough to merge, so a group is its key. The best is found by max_by, which
    combines before the shuffle; so a file with very many findings costs a row for each task.
    """
    file, bucket = fingerprint(F.col("file"), F.col("line"))
    keyed = findings.select("*", rules.category(F.col("scanner_id")).alias("category"), file.alias("at_file"), bucket.alias("bucket"), rules.priority(F.col("severity"), F.col("confidence")).alias("priority"))
    best = keyed.groupBy("category", "at_file", "bucket").agg(F.max_by(F.struct(*findings.columns, "priority"), F.struct("score", (-F.col("priority")).alias("p"), "ord")).alias("f"))
    return best.select("category", "at_file", "bucket", "f.*")


def dedup_stats(findings: DataFrame) -> DataFrame:
    """Counts before and after, and the reduction in per cent (0 without findings)."""
    file, bucket = fingerprint(F.col("file"), F.col("line"))
    keys = findings.select(rules.category(F.col("scanner_id")).alias("category"), file.alias("f"), bucket.alias("b")).groupBy("category", "f", "b").agg(F.count(F.lit(1)).alias("n"))
    out = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("original"), F.count(F.lit(1)).alias("deduplicated"))
    return out.select("original", "deduplicated", (F.col("original") - F.col("deduplicated")).alias("removed"), F.when(F.col("original") > 0, F.round(100.0 * (F.col("original") - F.col("deduplicated")) / F.col("original"), 4)).otherwise(F.lit(0.0)).alias("reduction"))


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(rules.SEVERITIES)), F.count(F.lit(1)).alias("total"))


def at_least(findings: DataFrame, severity: str, score: float) -> DataFrame:
    return findings.where((rules.severity_rank(F.col("severity")) >= rules.SEVERITIES.index(severity)) & (F.col("score") >= score))


def key_string(findings: DataFrame) -> DataFrame:
    return findings.withColumn("dedup_key", F.concat_ws(":", "finding_type", "scanner_id", "file", "line", "column"))


def markdown(findings: DataFrame) -> DataFrame:
    """A line of a report for each finding; titles of more than 60 characters are cut."""
    short = F.when(F.length("title") > 60, F.concat(F.substring("title", 1, 57), F.lit("..."))).otherwise(F.col("title"))
    return findings.withColumn("markdown", F.format_string("- **%s** (%s) %s at %s:%d", "severity", "confidence", short, "file", "line"))


def rolled_up(found: DataFrame, *by: str, score: str = "score", places: int = 3) -> DataFrame:
    """(dimension, value, findings, mean, highest, first): findings by each of the columns and over all (dimension `all`): how many,
    their mean score, the highest severity, and the first places (`file:line`) of each.

    Counts come from one aggregate by grouping sets. The first places of a set are among the first ones of its parts, so each
    combination of the columns gives its few, each task its few of those, and no row holds all places of a set.
    """
    rank = F.array_position(F.array(*map(F.lit, rules.SEVERITIES)), F.col("severity"))
    held = found.select(F.col(score).alias("_score"), rank.alias("_rank"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("_place"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(by)))
    names = [f"_{i}" for i in range(len(by))]
    sets = held.groupingSets([[c] for c in names] + [[]], *names)
    dimension, value = F.lit("all"), F.lit("")
    for n, c in zip(names, by, strict=True):
        dimension, value = F.when(F.grouping(n) == 0, c).otherwise(dimension), F.when(F.grouping(n) == 0, F.col(n).cast("string")).otherwise(value)
    counts = sets.agg(dimension.alias("dimension"), value.alias("value"), F.count(F.lit(1)).alias("findings"), F.round(F.avg("_score"), 6).alias("mean"), F.max("_rank").alias("r"))
    least = lambda df, *keys: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))).where(F.col("n") <= places).drop("n")
    parts = least(held.select(*names, "_place").distinct(), *names)
    every = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(n).cast("string").alias("value")) for n, c in zip(names, by, strict=True)), F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")))
    some = least(parts.select("_place", F.explode(every).alias("s")).select("s.*", "_place").distinct(), "dimension", "value")
    first = some.groupBy(F.col("dimension").alias("d"), F.col("value").alias("v")).agg(F.array_sort(F.collect_list("_place")).alias("first"))
    out = counts.join(first, F.col("dimension").eqNullSafe(F.col("d")) & F.col("value").eqNullSafe(F.col("v")), "left")
    return out.select("dimension", "value", "findings", "mean", F.get(F.array(*map(F.lit, rules.SEVERITIES)), (F.col("r") - 1).cast("int")).alias("highest"), F.coalesce("first", F.array().cast("array<string>")).alias("first"))


def cross_checked(found: DataFrame, group: str, tier: str) -> DataFrame:
    """(group, detector, model, agree): for each group of findings the pairs of a detector and a model (tier true) that both report
    in it, and whether they give it one severity. A detector is one side once a group and severity, so that pairs stay few."""
    side = lambda on, name, level: found.where(on).groupBy(group, F.col("scanner_id").alias(name)).agg(F.max(F.array_position(F.array(*map(F.lit, rules.SEVERITIES)), F.col("severity"))).alias(level))
    return side(~F.col(tier), "detector", "x").join(side(F.col(tier), "model", "y"), group).select(group, "detector", "model", (F.col("x") == F.col("y")).alias("agree"))
