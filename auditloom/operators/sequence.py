"""Order of events within a function: calls before writes, checks before the next call, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def call_write_pairs(events: DataFrame, by: list[str], order: list[str], call: Column, write: Column) -> DataFrame:
    """Per function, how many pairs of a call and a later write there are: a running count, not a self-join."""
    before = F.count_if(call).over(_within(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("calls", before).where(write).groupBy(*by).agg(F.sum("calls").alias("pairs"), F.count_if(F.col("calls") > 0).alias("writes_after_call")).where("pairs > 0")


def first_after(events: DataFrame, by: list[str], order: list[str], call: Column, write: Column, value: str) -> DataFrame:
    """Each call with the value of the first write after it."""
    later = F.first(F.when(write, F.col(value)), ignorenulls=True).over(_within(by, order).rowsBetween(1, Window.unboundedFollowing))
    return events.withColumn("first_write", later).where(call & F.col("first_write").isNotNull())


def unchecked_calls(events: DataFrame, by: list[str], order: list[str], call: Column, check: Column) -> DataFrame:
    """Calls that no check follows before the next call."""
    part = F.count_if(call).over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0))
    runs = events.withColumn("run", part).where("run > 0")
    return runs.groupBy(*by, "run").agg(F.count_if(check).alias("checks")).groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("checks") == 0).alias("unchecked"))


def gas_findings(functions: DataFrame, ops: str, loops: str) -> DataFrame:
    """Functions with many storage operations in loops."""
    kind = F.when((F.col(ops) > 5) & (F.col(loops) > 0), "gas-limit-dos").when((F.col(ops) > 3) & (F.col(loops) > 0), "moderate-gas-dos")
    severity = F.when(F.col(ops) <= 5, "Low").when((F.col(ops) > 10) | (F.col(loops) > 2), "High").otherwise("Medium")
    return functions.select("*", kind.alias("finding_type"), severity.alias("severity")).where("finding_type is not null")


def overflow_matrix(op: Column, external: Column, loop: Column) -> tuple[Column, Column]:
    """(severity, confidence) of an operation on external data, in a loop or not; null: no finding."""
    severity = F.when((op == "mul") & external & loop, "High").when((op == "mul") & external, "Medium").when((op == "sub") & external, "High").when((op == "add") & external, "Medium")
    confidence = F.when(external & loop & op.isin("mul", "sub", "add"), "High").when(external & op.isin("mul", "sub", "add"), "Medium")
    return severity, confidence
