"""Source text as lines: numbering, context, comments, functions by brace depth, and detectors on their bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import pick


def lines(sources: DataFrame, key: str, text: str) -> DataFrame:
    return sources.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line_text")).select(key, (F.col("pos") + 1).cast("long").alias("line"), "line_text")


def numbered(text: Column) -> Column:
    """Each line behind its number, four wide."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def stripped(text: Column) -> Column:
    """Without comments (one that isn't closed goes to the end), and without the lines that are blank then."""
    code = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?(\*/|$)", ""), r"//[^\n]*", "")
    return F.array_join(F.filter(F.split(code, "\n"), lambda x: F.trim(F.translate(x, "\t\r", "  ")) != ""), "\n")


def context(all_lines: DataFrame, key: str, hit: Column, before: int = 3, after: int = 3) -> DataFrame:
    """Hit lines with the lines around them."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(-before, after)
    return all_lines.withColumn("snippet", F.array_join(F.collect_list("line_text").over(w), "\n")).where(hit)


def functions_of(sources: DataFrame, key: str = "file", text: str = "content") -> DataFrame:
    """(key, contract, func, visibility, mutability, line, body) of each function with a body.

    Comments go first. A header may span lines; a function ends on the line where its braces balance. Depths and function
    numbers are running counts over a file's lines, so no parser runs and a file is one window.
    """
    all_lines = lines(sources.select(key, without_comments(F.col(text)).alias(text)), key, text)
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    change = F.length(F.regexp_replace("line_text", r"[^{]", "")) - F.length(F.regexp_replace("line_text", r"[^}]", ""))
    named = F.regexp_extract("line_text", r"\b(?:contract|library|interface)\s+(\w+)", 1)
    header = F.col("line_text").rlike(r"^\s*(function\b|constructor\s*\(|fallback\s*\(|receive\s*\()")
    marked = all_lines.withColumns({"depth": F.sum(change).over(w), "contract": F.last(F.when(named != "", named), ignorenulls=True).over(w), "f": F.count_if(header).over(w), "start": header}).where("f > 0")
    opened = marked.withColumn("level", F.first(F.col("depth") - change).over(Window.partitionBy(key, "f").orderBy("line")))
    inside = Window.partitionBy(key, "f").orderBy("line")
    closed = opened.withColumn("ended", F.coalesce(F.max(((F.col("depth") <= F.col("level")) & F.col("line_text").rlike("[;}]")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("ended = 0")
    whole = closed.groupBy(key, "contract", "f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda x: x["line_text"]), "\n").alias("code"), F.min("line").alias("line")).where(F.col("code").contains("{"))
    head = F.substring_index("code", "{", 1)
    first = lambda pattern, otherwise: F.coalesce(F.nullif(F.regexp_extract(head, pattern, 1), F.lit("")), F.lit(otherwise))
    return whole.select(key, "contract", F.coalesce(F.nullif(F.regexp_extract(head, r"function\s+(\w+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"^\s*(constructor)", 1), F.lit("")), F.lit("fallback")).alias("func"), first(r"\b(public|external|internal|private)\b", "internal").alias("visibility"), first(r"\b(view|pure|payable)\b", "").alias("mutability"), "line", F.expr("substring(code, instr(code, '{'))").alias("body"), head.alias("header"))


def timestamp_findings(lines_: DataFrame, name: str, mutability: str, text: str) -> DataFrame:
    """Lines that read the block time and take a remainder, compare for equality, branch or return: severity and score."""
    t = F.trim(text)
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: t.contains(p))
    mod, eq, ret = has("%"), has("==", "!="), has("return ")
    in_if = t.startswith("if ") | t.contains(" if ")
    random = has("keccak256", "sha256") | (mod & in_if)
    req = has("require", "revert")
    safe = (req & has(" > ", " >= ", " < ", " <= ")) | (req & eq & has("last", "prev"))
    assign = has("=") & ~eq & ~in_if & ~ret & ~mod
    used = mod | eq | in_if | ret
    severity = F.when(random, "High").when(safe, "Low").when(mod, "High").otherwise("Medium")
    score = F.when(random, 0.9).when(safe, 0.4).when(mod, 0.85).when(in_if | ret, 0.7).otherwise(0.6)
    view = F.col(mutability).isin("view", "pure")
    out = lines_.where(has("block.timestamp", "now") & ~assign & used).withColumns({"severity": severity, "score": score, "random": random})
    return out.where(~(F.col(name).rlike("^is[A-Z]") & view & ~F.col("random") & (F.col("score") < 0.7)) & ~(view & (F.col("score") < 0.6))).drop("random")


#: Operations that move value or ownership; what shows, in the code or among the modifiers, that the caller is checked.
SENSITIVE = r"\.transfer\(|\.send\(|\.call\{value:|selfdestruct\(|delegatecall\(|(owner|admin) ?=(?!=)|_mint\(|_burn\(|totalSupply (\+|-)?= "
GUARDS = "only(Owner|Admin|Role|Governance|Minter|Pauser|Controller)|auth|restricted"
SENSITIVE_KINDS = ("unprotected-ether-withdrawal", "unprotected-ownership-change", "unprotected-selfdestruct", "missing-access-control")


def access_findings(functions: DataFrame) -> DataFrame:
    """Public functions that move value or ownership without a check of the caller. Columns func, visibility, mutability, header, body.

    Sensitive operations and guards are looked for in the whole text, checks in the code without // comments.
    """
    body, code = F.col("body"), F.regexp_replace("body", r"//[^\n]*", "")
    whole = F.concat_ws(" ", "header", "body")
    sender = code.contains("msg.sender")
    checked = (code.contains("require") & sender & code.rlike("owner|admin")) | (code.contains("revert") & code.rlike("owner|admin|authorized")) | (code.contains("assert") & sender & code.contains("owner")) | code.rlike(r"(OnlyOwner|Unauthorized|NotOwner)\(\)")
    own = F.lower("func").contains("deposit") | (F.lower("func").contains("withdraw") & body.rlike(r"(balances|deposits|stakes)\[msg\.sender\]"))
    kind = F.when(body.rlike(r"\.transfer\(|\.send\(|\.call\{value:"), SENSITIVE_KINDS[0]).when(body.rlike("(owner|admin) ?=(?!=)"), SENSITIVE_KINDS[1]).when(body.contains("selfdestruct("), SENSITIVE_KINDS[2]).otherwise(SENSITIVE_KINDS[3])
    severity = pick(kind, SENSITIVE_KINDS, ("High", "Critical", "Critical", "Medium"))
    open_ = ~F.col("mutability").isin("view", "pure") & ~F.col("visibility").isin("private", "internal")
    return functions.where(body.rlike(SENSITIVE) & ~checked & ~whole.rlike(GUARDS) & ~own & open_).withColumns({"finding_type": kind, "severity": severity})


def gas_limit_findings(loops: DataFrame) -> DataFrame:
    """for loops over arrays that callers can grow, with costly bodies. Columns condition, body, params."""
    costly = F.col("body").rlike(r"\+=|-=| = |push\(|delete |\.transfer\(|\.send\(|\.call\{|\.call\(")
    over = F.regexp_extract("condition", r"(\w+)\.length", 1)
    grown = F.expr(r"params rlike concat('\\[\\] (memory|calldata) ', regexp_extract(condition, '(\\w+)\\.length', 1))") | over.isin("participants", "recipients", "addresses", "users", "investors", "voters")
    kind = F.when(F.col("body").rlike(r"\.transfer\(|\.call\{"), "gas-limit-dos-external-call").when(F.col("body").contains("delete "), "gas-limit-dos-delete").otherwise("gas-limit-dos")
    return loops.where((over != "") & grown & costly).withColumns({"finding_type": kind, "severity": F.when(kind == "gas-limit-dos-external-call", "Critical").otherwise("High")})
