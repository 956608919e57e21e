"""Texts for and from a language model: marks in source, budgets, templates, calls with retries, and findings out of answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is put behind a line that calls, writes, checks or opens an unchecked block.
CALL, WRITE, CHECK, UNCHECKED = " 🔴 // EXTERNAL CALL", " 🟡 // STATE WRITE", " ✅ // CHECK", " ⚠️ // UNCHECKED BLOCK"
ANSWER = "struct<findings: array<struct<title: string, severity: string, confidence: double, function: string, line: bigint, description: string>>>"
#: What an analysis may look at, as a condition on instructions.
FOCUS = {
    "reentrancy": "op IN ('Call', 'DelegateCall', 'StaticCall', 'StorageStore', 'MappingStore', 'ArrayStore')", "access_control": "op IN ('Require', 'Assert', 'TxOrigin', 'GetContext', 'Selfdestruct')",
    "arithmetic": "op IN ('Add', 'Sub', 'Mul', 'Div', 'CheckedAdd', 'CheckedSub', 'CheckedMul', 'CheckedDiv')", "time": "op IN ('BlockTimestamp', 'BlockNumber', 'BlockDifficulty')", "state": "op IN ('StorageLoad', 'StorageStore', 'MappingLoad', 'MappingStore')",
}


def marked_line(line: Column) -> Column:
    t = F.trim(line)
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(t, p))
    call = has(".call{", ".call(", "msg.sender.call") | (has("address(") & has(".call"))
    balance = t.startswith("balances[") | has(" balances[")
    storage = has("storage", "mapping")
    written = F.when(balance, has("=") & ~has("==", ">=", "<=")).otherwise(storage & has("=") & ~has("=="))
    return F.when(call, CALL).when(balance | storage, F.when(written, WRITE).otherwise("")).when(t.startswith("require(") | t.startswith("assert("), CHECK).when(has("unchecked {"), UNCHECKED).otherwise("")


def marked(text: Column) -> Column:
    """Each line behind its number, with a mark behind it where it calls, writes, checks or isn't checked."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(" | "), x, marked_line(x))), "\n")


def focused(functions: DataFrame, name: str | None = None, contract: str | None = None, pattern: str | None = None) -> DataFrame:
    """Functions by name, by contract, or by a pattern in their text."""
    out = functions
    for on, column in ((name, "func"), (contract, "contract")):
        out = out if on is None else out.where(F.col(column) == on)
    return out if pattern is None else out.where(F.col("body").rlike(pattern))


def in_focus(instr: DataFrame, focus: str) -> DataFrame:
    """(contract, func, op, n): what an analysis of that focus looks at."""
    return instr.where(FOCUS[focus]).groupBy("contract", "func", "op").agg(F.count(F.lit(1)).alias("n"))


def tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def within_budget(rows: DataFrame, by: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Rows from the first on as long as their tokens together fit the budget, with tokens and used."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("tokens", tokens(F.col(text))).withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def answered(prompts: DataFrame, ask: Callable[[str], str], *, text: str = "prompt", attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """prompts with `answer` and `error`: ask() of each prompt in the tasks, tried again after growing pauses."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for prompt in frame[text]:
                wait, error = pause, None
                for left in range(attempts - 1, -1, -1):
                    try:
                        out.append((ask(prompt), None))
                        break
                    except Exception as e:  # whatever a provider raises is its row's error
                        error = f"{type(e).__name__}: {e}"
                        if left:
                            time.sleep(wait)
                            wait *= 2
                else:
                    out.append((None, error))
            yield frame.assign(answer=[a for a, _ in out], error=[e for _, e in out])

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))


def _object(depth: int) -> str:
    """A pattern of an object by its braces, up to a depth; strings are passed over. Possessive, so that it never goes back."""
    out = r"\{(?:[^{}\"]++|\"(?:[^\"\\]|\\.)*+\")*+\}"
    for _ in range(depth - 1):
        out = r"\{(?:[^{}\"]++|\"(?:[^\"\\]|\\.)*+\"|" + out + r")*+\}"
    return out


def json_of(text: Column, depth: int = 8) -> Column:
    """The JSON in an answer: what a fence holds, else the first object by its braces (those in strings don't count), else the text.
    Objects of up to `depth` levels are found by one pattern; only deeper or broken ones are gone through by character."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    found = F.regexp_extract(text, r"^(?s)[^{]*(" + _object(depth) + ")", 1)
    rest = F.substr(text, F.locate("{", text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("skip"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quote, active = (c == '"') & ~s["skip"], ~s["inside"] & ~s["skip"]
        depth = s["depth"] + F.when(active & (c == "{"), 1).when(active & (c == "}"), -1).otherwise(0)
        over = (s["end"] == 0) & (depth == 0) & (c == "}") & active
        return F.struct(depth.alias("depth"), F.when(quote, ~s["inside"]).otherwise(s["inside"]).alias("inside"), ((c == "\\") & s["inside"] & ~s["skip"]).alias("skip"), (s["at"] + 1).alias("at"), F.when(over, s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["end"])
    return F.when(fence != "", fence).when(found != "", found).when((F.locate("{", text) > 0) & (end > 0), F.substr(rest, F.lit(1), end)).otherwise(text)


def findings_of(answers: DataFrame, keep: list[str], answer: str = "answer", least: float = 0.0) -> DataFrame:
    """keep and the findings in the answers' JSON (see ANSWER): severities as ours, those of a confidence under `least` left out."""
    parsed = answers.select(*keep, F.explode(F.from_json(json_of(F.col(answer)), ANSWER)["findings"]).alias("f")).select(*keep, "f.*")
    return parsed.withColumn("severity", F.initcap(F.lower("severity"))).where(F.coalesce("confidence", F.lit(0.5)) >= least)
