"""Detectors on the facts of Solidity sources. Each takes Facts and gives findings; DETECTORS lists them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import source_text
from .facts import Facts, spans_of, within

COLUMNS = ("scanner_id", "finding_type", "severity", "confidence", "score", "title", "file", "contract", "function", "line", "end_line", "snippet")
LOOP_NAMES = {"For": "for", "While": "while", "DoWhile": "do-while"}
#: Names of functions that draw lots, tokens of values that callers choose, ends of calls that move control.
RANDOM = "random|lottery|winner|shuffle"
USER = ("msg.sender", "msg.value", "tx.origin", "amount", "value", "_amount", "_value")
CRITICAL = ("balance", "totalsupply", "allowance", "owner")
CALLS = (".call(", ".call{", ".send(", ".transfer(", ".delegatecall(")


def findings(rows: DataFrame, scanner: str, kind: Column | str, severity: Column | str, confidence: Column | str, title: Column, *, score: Column | None = None, snippet: str = "snippet", end_line: str = "line") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    level = lit(confidence)
    return rows.select(
        F.lit(scanner).alias("scanner_id"), lit(kind).alias("finding_type"), lit(severity).alias("severity"), level.alias("confidence"),
        (rules.pick(level, rules.CONFIDENCES, rules.CONFIDENCE_SCORES) if score is None else score).cast("double").alias("score"), title.alias("title"),
        "file", "contract", F.col("func").alias("function"), F.col("line").cast("long").alias("line"), F.col(end_line).cast("long").alias("end_line"), F.col(snippet).alias("snippet"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kinds(rows: DataFrame, *cases: tuple[Column, str, str, str]) -> DataFrame:
    """rows once for each case (when, kind, severity, confidence) that holds, with the columns k, s and c: one pass, not one a case."""
    each = F.array(*(F.when(on, F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(c).alias("c"))) for on, k, s, c in cases))
    return rows.withColumn("_", F.explode(F.filter(each, lambda x: x.isNotNull()))).select(*rows.columns, "_.*")


def _at(text: str) -> Column:
    return F.concat(F.lit(text), F.col("line"))


def top_lines(column: str = "body") -> Column:
    """The first three lines of a body."""
    return F.array_join(F.slice(F.split(column, "\n"), 1, 3), "\n")


def is_call(stmt: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CALLS)), lambda c: F.contains(stmt, c))


def is_state_write(stmt: Column) -> Column:
    """An assignment that declares nothing, to an element, a member (of no message, block or transaction) or a lower-case name."""
    left = F.trim(F.substring_index(stmt, "=", 1))
    assigns = stmt.contains("=") & ~stmt.contains("==") & ~stmt.contains("!=") & ~stmt.contains("=>") & ~stmt.rlike(r"^(uint |address |bool |bytes|string |int )")
    element, member = left.contains("[") & left.contains("]"), left.contains(".") & ~left.rlike(r"^(msg|block|tx)\.")
    return assigns & (element | member | (~left.contains(".") & ~left.contains("[") & ~left.contains("(") & left.rlike(r"^\p{Ll}")))


def classic_reentrancy(facts: Facts) -> DataFrame:
    """A finding for each pair of a call and a later write to the state among a function's top statements.

    The pairs are counted in order: each write takes the array of the calls before it, so that no join pairs statements.
    """
    by = ["file", "contract", "func", "f_pos"]
    top = F.count_if(F.col("level") == 0).over(Window.partitionBy(*by).orderBy("pos"))  # a statement with braces takes in what is inside
    whole = facts.statements.withColumn("top", top).groupBy(*by, "top").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"), F.array_sort(F.collect_list(F.struct("pos", "stmt"))).alias("all"))
    s = whole.withColumn("stmt", F.array_join(F.transform("all", lambda x: x["stmt"]), " ")).drop("all").withColumns({"is_call": is_call(F.col("stmt")), "is_write": is_state_write(F.col("stmt"))}).where("is_call OR is_write")
    before = Window.partitionBy("file", "contract", "func", "f_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    call = F.when(F.col("is_call"), F.struct("line", "stmt"))
    pairs = s.withColumn("calls", F.collect_list(call).over(before)).where("is_write").select("file", "contract", "func", F.explode("calls").alias("c"), F.col("line").alias("write_line"))
    rows = pairs.select("file", "contract", "func", F.col("c.line").alias("line"), "write_line", F.col("c.stmt").alias("snippet"))
    return findings(rows, "classic-reentrancy", "classic-reentrancy", "High", "High", F.concat(F.lit("State written after a call in "), F.col("func")), end_line="write_line")


def loop_reentrancy(facts: Facts) -> DataFrame:
    rows = facts.loops_before_assignments().where("contains_external_calls").withColumn("snippet", top_lines())
    return findings(rows, "source-loop-reentrancy", "source-loop-reentrancy", "High", "High", F.concat(F.lit("Calls in a loop before a write in "), F.col("func")), score=F.lit(0.9), end_line="end_line")


def integer_overflow(facts: Facts) -> DataFrame:
    """Products in loops, a product that is divided (the first of each contract), sums over loops; not from version 0.8 on."""
    product, summed = F.col("stmt").rlike(r"[\w\])]\s*\*(?![*=])\s*[\w(]"), F.col("stmt").rlike(r"^[A-Za-z_$][\w$]+\s*\+=")
    divided = F.col("stmt").rlike(r"\([^()]*[^*]\*[^*=][^()]*\)\s*/|[\w\])]\s*\*\s*[\w.\[\]]+\s*/")
    stmts = facts.statements.where("NOT checked").withColumn("snippet", F.col("stmt"))
    looped = within(stmts.where(product | summed), facts.loops.where("NOT checked"))
    first = stmts.where(divided).withColumn("n", F.row_number().over(Window.partitionBy("file", "contract").orderBy("pos"))).where("n = 1")
    kind, line = F.col("k"), F.col("line")
    what = rules.pick(kind, ("integer-overflow-multiplication-loop", "integer-overflow-accumulation"), ("Product in a loop at line ", "Sum over a loop at line "))
    each = kinds(looped, (product, "integer-overflow-multiplication-loop", "High", "High"), (summed, "integer-overflow-accumulation", "Medium", "Medium"))
    in_loops = findings(each, "source-integer-overflow", kind, F.col("s"), F.col("c"), F.concat(what, line), score=F.when(F.col("c") == "High", 0.9).otherwise(0.75))
    return in_loops.unionByName(findings(first, "source-integer-overflow", "integer-overflow-mul-div", "Medium", "High", _at("Product before a division at line "), score=F.lit(0.85)))


def unchecked_return(facts: Facts) -> DataFrame:
    kind = F.when(F.col("call_type").startswith("ERC20"), "unchecked-return-source").when(F.col("call_type") == "Send", "unchecked-send-source").otherwise("unchecked-lowlevel-call-source")
    rows = facts.unchecked_calls().where("call_type <> 'Transfer'").withColumn("snippet", F.col("text"))
    return findings(rows, "source-unchecked-return", kind, "Medium", "High", F.concat(F.lit("Result of "), F.lower("call_type"), _at(" not checked at line ")))


def dangerous_functions(facts: Facts) -> DataFrame:
    s = facts.statements.withColumn("snippet", F.col("stmt"))
    f = lambda rows, kind, sev: findings(rows, "source-dangerous-functions", kind, sev, "High", _at("Dangerous operation at line "))
    destroy = s.withColumn("hit", F.explode(F.regexp_extract_all("stmt", F.lit(r"(?<![\w.])(selfdestruct|suicide)\s*\("), F.lit(1))))
    delegate = facts.calls.where(F.col("text").contains(".delegatecall")).withColumn("snippet", F.col("text"))
    assembly = spans_of(facts.functions, r"^assembly\b").where(F.col("body").rlike("selfdestruct|delegatecall|callcode")).withColumn("snippet", top_lines())
    return union([f(destroy, "dangerous-selfdestruct-source", "High"), f(delegate, "dangerous-delegatecall-source", "High"), f(assembly, "dangerous-assembly-source", "Medium")])


def _body_lines(facts: Facts) -> DataFrame:
    """Each line of each function's body, with its number."""
    f = facts.functions.withColumn("open", F.col("line") + F.length("header") - F.length(F.replace("header", F.lit("\n"), F.lit(""))))
    out = f.select("file", "contract", "func", "mutability", "params", "open", F.posexplode(F.split("body", "\n")).alias("i", "text"))
    return out.withColumn("line", F.col("open") + F.col("i"))


def delegatecall(facts: Facts) -> DataFrame:
    """Targets of delegatecall that a parameter's text holds, or that are neither constant nor immutable."""
    target = F.element_at(F.filter(F.split(F.substring_index("text", ".delegatecall(", 1), r"\s+"), lambda x: x != ""), -1)
    hits = _body_lines(facts).where(F.col("text").contains(".delegatecall(")).withColumn("target", target).where("target IS NOT NULL").join(facts.sources, "file")
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(" ", p["type_name"], p["name"])), ", ")
    fixed = F.lit(False)
    for word in ("immutable", "constant"):
        fixed = fixed | F.contains("content", F.concat(F.lit(word + " "), F.col("target"))) | F.contains("content", F.concat(F.col("target"), F.lit(" " + word)))
    user = F.contains(params, F.col("target"))
    rows = hits.where(user | ~fixed).withColumn("snippet", F.trim("text"))
    return findings(rows, "source-delegatecall", F.when(user, "delegatecall-to-user-controlled").otherwise("delegatecall-to-mutable"), F.when(user, "Critical").otherwise("High"), "High", F.concat(F.lit("Unsafe delegatecall in "), F.col("func")))


def dos(facts: Facts) -> DataFrame:
    """Loops of no constant bound that call, write a lot or run over a length."""
    c = F.col("condition")
    constant = c.rlike(r"\p{N}") & ~c.contains(".length") & ~c.contains("(") & ~c.contains("[")
    l, ext, writes, length = facts.loops.where(~constant).withColumn("snippet", top_lines()), F.col("contains_external_calls"), F.col("contains_storage_writes"), F.col("iterates_over_length")
    found = kinds(l, (ext & (writes | length), "dos-external-call-loop-source", "High", "High"), (writes & (ext | length), "dos-gas-limit-loop-source", "Medium", "Medium"), (length & ~ext & ~writes, "dos-unbounded-loop-source", "Low", "Low"))
    return findings(found, "source-dos-vulnerabilities", F.col("k"), F.col("s"), F.col("c"), _at("Unbounded loop at line "), end_line="end_line")


def ast_dos(facts: Facts) -> DataFrame:
    l = facts.loops.withColumn("snippet", top_lines())
    found = kinds(l, (F.col("contains_external_calls"), "dos-external-call-loop-ast", "High", "High"), (F.col("contains_storage_writes"), "dos-gas-limit-loop-ast", "High", "High"), (F.col("iterates_over_length"), "dos-unbounded-loop-ast", "Medium", "High"))
    required = facts.unchecked_calls().where("call_type IN ('Call', 'DelegateCall', 'Send')").where(F.col("text").contains("require")).withColumn("snippet", F.col("text"))
    looped = findings(found, "ast-dos-vulnerabilities", F.col("k"), F.col("s"), F.col("c"), F.concat(rules.pick(F.col("loop_type"), tuple(LOOP_NAMES), tuple(LOOP_NAMES.values())), _at(" loop at line ")), end_line="end_line")
    return looped.unionByName(findings(required, "ast-dos-vulnerabilities", "dos-require-external-call-ast", "Medium", "High", _at("Required call at line ")))


def gas_limit(facts: Facts) -> DataFrame:
    l = facts.loops.where("loop_type = 'For'").withColumn("params", F.regexp_extract("f_header", r"\(([^)]*)\)", 1))
    rows = source_text.gas_limit_findings(l).withColumn("snippet", top_lines())
    return findings(rows, "source-gas-limit-dos", F.col("finding_type"), F.col("severity"), "High", _at("Loop over an array that callers grow at line "), end_line="end_line")


def missing_access_control(facts: Facts) -> DataFrame:
    f = source_text.access_findings(facts.functions)
    i = F.array_position(F.transform(F.split("body", "\n"), lambda x: x.rlike(source_text.SENSITIVE)), F.lit(True)) - 1
    rows = f.withColumn("line", F.col("line") + F.greatest(i, F.lit(0)) + F.length("header") - F.length(F.replace("header", F.lit("\n"), F.lit("")))).withColumn("snippet", F.trim(F.get(F.split("body", "\n"), F.greatest(i, F.lit(0)).cast("int"))))
    return findings(rows, "source-missing-access-control", F.col("finding_type"), F.col("severity"), "High", F.concat(F.lit("No check of the caller in "), F.col("func")))


def time_vulnerabilities(facts: Facts) -> DataFrame:
    """Statements that read the time or number of the block: a row for each place of each kind, all kinds in one pass."""
    s = facts.statements.where(F.col("stmt").rlike(r"block\.(?:difficulty|prevrandao|number|timestamp)|now")).withColumn("snippet", F.col("stmt"))
    low, stmt = F.lower("func"), F.col("stmt")
    random = low.rlike(RANDOM)
    hashed = stmt.rlike(r"\b(keccak256|sha256|sha3)\s*\(") & (stmt.contains("block.timestamp") | stmt.contains("now")) & random
    comparison = stmt.rlike(r"==|!=|<|>")
    timelock = low.rlike("withdraw|claim|unlock") & stmt.rlike(" >=? ") & stmt.rlike("require|revert")
    assigned = stmt.contains("=") & ~comparison & ~stmt.contains("if ") & ~stmt.contains("return ")
    used = (comparison | stmt.rlike(r"[+\-*/%]")) & ~timelock & ~assigned
    places = lambda pattern: F.size(F.regexp_extract_all("stmt", F.lit(pattern), F.lit(0)))
    each = lambda n, kind, severity, what: F.array_repeat(F.struct(F.lit(kind).alias("k"), severity.alias("s"), F.lit(what).alias("w")), n)
    found = F.concat(
        each(places(r"block\.(?:difficulty|prevrandao)\b"), "block-difficulty-source", F.lit("High"), "Block difficulty at line "),
        each(F.when(hashed, 1).otherwise(0), "timestamp-randomness-source", F.lit("High"), "Hash of the time at line "),
        each(F.when(random, places(r"block\.number\b")).otherwise(0), "block-number-randomness-source", F.lit("Medium"), "Block number at line "),
        each(F.when(used, places(r"block\.timestamp\b")).otherwise(0), "timestamp-source", F.when(stmt.contains("%"), "High").otherwise("Medium"), "Time used at line "),
    )
    rows = s.withColumn("_", F.explode(found)).select(*s.columns, "_.*")
    return findings(rows, "source-time-vulnerabilities", F.col("k"), F.col("s"), "High", F.concat("w", "line"))


def simple_timestamp(facts: Facts) -> DataFrame:
    rows = source_text.timestamp_findings(_body_lines(facts), "func", "mutability", F.col("text")).withColumn("snippet", F.trim("text"))
    return findings(rows, "simple-timestamp", "simple-timestamp", F.col("severity"), rules.confidence_level(F.col("score")), _at("Time read at line "), score=F.col("score"))


def unchecked_operations(facts: Facts) -> DataFrame:
    """(file, contract, func, line, snippet, left, operator, right, context, user, critical, validated) in unchecked blocks."""
    blocks_ = spans_of(facts.functions, r"^unchecked$")
    held = within(facts.statements.where("step <> 1 OR stmt RLIKE '^(for|while)'"), blocks_)
    side = r"[\w$.]+(?:\[[^\[\]]*(?:\[[^\[\]]*\])*[^\[\]]*\])*"
    pattern = rf"({side})\s*(\+\+|--|\+=|-=|\*=|\+|-(?!-)|\*(?!\*))\s*({side})?"
    ops = held.withColumn("op", F.explode(F.regexp_extract_all("stmt", F.lit(pattern), F.lit(0))))
    ops = ops.withColumns({"left": F.regexp_extract("op", pattern, 1), "operator": F.regexp_extract("op", pattern, 2), "right": F.regexp_extract("op", pattern, 3)}).where(~F.col("left").rlike(r"^\d") | ~F.col("right").rlike(r"^\d"))
    left, low = F.col("left"), F.lower("left")
    context = (
        F.when(low.contains("balance") & ~low.contains("allowance"), "Balance").when(low.contains("allowance"), "Allowance").when(low.rlike("totalsupply|total_supply"), "TotalSupply")
        .when(left.contains("[") & ((F.length(left) - F.length(F.replace(left, F.lit("["), F.lit(""))) > 1) | F.contains("right", F.lit("["))), "ArrayIndex").when(left.contains("["), "Mapping")
        .when(low.isin("i", "j", "k") | low.startswith("_i"), "LoopCounter")
    )
    either = F.concat_ws(" ", "left", "right")
    user = F.exists(F.array(*map(F.lit, USER)), lambda u: F.contains(either, u))
    critical = F.exists(F.array(*map(F.lit, CRITICAL)), lambda c: F.contains(F.lower(either), c))
    required = facts.statements.where(F.col("stmt").rlike(r"\b(require|assert)\s*\(")).groupBy("file", "f_pos").agg(F.min("pos").alias("first_check"))
    state = facts.parts.where(F.col("before") == 1).select("file", F.regexp_extract("piece", r"^[\w.\[\]() =>]+?\s(?:public |private |internal |constant |immutable )*([\w$]+)\s*(?:=[^;]*)?;$", 1).alias("root")).where("root <> ''").distinct().withColumn("is_state", F.lit(True))
    ops = ops.withColumn("root", F.regexp_extract("left", r"^([\w$]+)", 1)).join(state, ["file", "root"], "left").join(required, ["file", "f_pos"], "left")
    context = F.coalesce(context, F.when(F.col("is_state"), "StateVar"), F.lit("General"))
    return ops.select("file", "contract", "func", "line", F.col("stmt").alias("snippet"), "left", "operator", "right", context.alias("context"), user.alias("user"), critical.alias("critical"), F.coalesce(F.col("first_check") < F.col("s_pos"), F.lit(False)).alias("validated"))


def unchecked_severity(context: Column, operator: Column, user: Column, critical: Column, validated: Column) -> tuple[Column, Column]:
    """(severity, confidence) by what an operation changes and who chooses its operands."""
    two = lambda on, a, b: F.when(on, a).otherwise(b)
    severity = (
        F.when(context.isin("Balance", "TotalSupply"), two(operator.isin("-=", "-"), "Critical", "High")).when(context == "Allowance", "High").when(context.isin("ArrayIndex", "StateVar"), two(user, "High", "Medium"))
        .when(context == "LoopCounter", two(user | ~validated, "Medium", "Low")).when(context == "Mapping", two(critical, "High", "Medium")).otherwise(two(user, "Medium", "Low"))
    )
    return severity, F.when(validated, "Low").when(critical | user, "High").otherwise("Medium")


def unchecked_arithmetic(facts: Facts) -> DataFrame:
    severity, confidence = unchecked_severity(F.col("context"), F.col("operator"), F.col("user"), F.col("critical"), F.col("validated"))
    return findings(unchecked_operations(facts), "unchecked-arithmetic", "unchecked-arithmetic", severity, confidence, F.concat(F.lit("Unchecked "), F.lower("context"), F.lit(" operation "), F.col("operator")))


def unchecked_overflow(facts: Facts) -> DataFrame:
    """The first unchecked block of each function, if it holds arithmetic."""
    b = spans_of(facts.functions, r"^unchecked$")
    first = b.withColumn("n", F.row_number().over(Window.partitionBy("file", "contract", "func").orderBy("pos"))).where("n = 1").where(F.col("body").rlike(r"\+\+|--|[+\-*]=|\s[+\-*]\s"))
    return findings(first.withColumn("snippet", F.lit("unchecked { ... }")), "source-unchecked-overflow", "unchecked-arithmetic", "High", "High", F.concat(F.lit("Unchecked arithmetic in "), F.col("func")), end_line="end_line")


@dataclass(frozen=True)
class Detector:
    """What the registry knows of a detector; run: Facts to findings; again: it reads the functions more than once, so that they
    are to be a table."""

    id: str
    severity: str
    confidence: str
    run: Callable[[Facts], DataFrame]
    enabled: bool = True
    again: bool = False


DETECTORS = (
    Detector("classic-reentrancy", "High", "High", classic_reentrancy), Detector("source-loop-reentrancy", "High", "High", loop_reentrancy, again=True), Detector("source-integer-overflow", "High", "High", integer_overflow, again=True),
    Detector("source-unchecked-return", "Medium", "High", unchecked_return), Detector("source-dangerous-functions", "High", "High", dangerous_functions, again=True), Detector("source-delegatecall", "Critical", "High", delegatecall),
    Detector("source-dos-vulnerabilities", "High", "High", dos), Detector("source-gas-limit-dos", "Critical", "High", gas_limit), Detector("source-missing-access-control", "Critical", "High", missing_access_control),
    Detector("simple-timestamp", "Medium", "Medium", simple_timestamp), Detector("source-unchecked-overflow", "High", "High", unchecked_overflow),
    Detector("ast-dos-vulnerabilities", "High", "High", ast_dos, False, True), Detector("source-time-vulnerabilities", "High", "High", time_vulnerabilities, False), Detector("unchecked-arithmetic", "High", "High", unchecked_arithmetic, False, True),
)
