"""Detectors and analyses on instructions: (contract, func, block, idx, pos, op, key, name, message) and functions (contract,
func, visibility, modifiers). pos orders a function's instructions; key is the storage an access touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

BY = ["contract", "func"]
#: Operations by what they do.
CALLS = ("Call", "DelegateCall", "StaticCall")
WRITES = ("StorageStore", "MappingStore", "ArrayStore", "Store")
READS = ("StorageLoad", "MappingLoad")
PRODUCTS = ("Mul", "Div", "CheckedMul", "CheckedDiv")
#: Names that tell oracles outside and within the contract, prices, their freshness, deviations and slippage; random draws; critical functions.
ORACLE, OWN_ORACLE, PRICE = "oracle|price|feed|chainlink|aggregator|latestround", "oracle|price|feed|latestround", "price|oracle|rate|exchange|swap|slippage|deviation"
FRESH, DEVIATION, SLIPPAGE = "stale|fresh|timestamp|time", "deviation|threshold|range", "slippage|minimum|expected"
RANDOM = "random|lottery|winner|shuffle"
BENIGN, SUSPICIOUS = "deadline|expire|timeout|cooldown|vesting|lock|delay|period", "owner|admin|authorized|allowed"
CRITICAL = "setowner|transferowner|renounceowner|mint|burn|destroy|upgrade|setadmin|addadmin|removeadmin|admin|governance|emergency|pause|unpause|freeze"
SELF_SERVICE, PERMISSION, TRIVIAL = "withdraw|deposit|claim|stake|unstake", "admin|owner|role|grant|revoke|pause|governance", "deposit|withdraw|claim|stake|unstake|test|simple"
DANGEROUS = ("selfdestruct", "suicide", "delegatecall", "callcode")


def is_call(op: Column) -> Column:
    return op.isin(*CALLS)


def is_write(op: Column) -> Column:
    return op.isin(*WRITES)


def call_edges(instr: DataFrame, functions: DataFrame) -> DataFrame:
    """(contract, caller, callee, pos, is_external): calls of a known function of the contract by its name or its name with
    types; any other call is external. A name meets the candidates that begin like it, not all functions."""
    calls = instr.where(is_call(F.col("op"))).select("contract", F.col("func").alias("caller"), "pos", "name")
    root = lambda c: F.regexp_extract(c, r"^([^_]*)", 1)
    known = functions.select(F.col("contract").alias("of"), F.col("func").alias("callee"), root(F.col("func")).alias("root"))
    met = calls.withColumn("root", root(F.col("name"))).join(known, (F.col("contract") == F.col("of")) & (root(F.col("name")) == known["root"]) & rules.same_function(F.col("callee"), F.col("name")), "left")
    return met.select("contract", "caller", F.coalesce("callee", "name").alias("callee"), "pos", F.col("callee").isNull().alias("is_external")).distinct()


def summaries(instr: DataFrame) -> DataFrame:
    """Per function: calls, first call, writes, last write, keys read and written. Where instr says what a call's target is, calls
    within the contract don't count."""
    op, pos = F.col("op"), F.col("pos")
    call = is_call(op) & (~F.col("target").eqNullSafe("Internal") & ~F.col("target").eqNullSafe("Builtin") if "target" in instr.columns else F.lit(True))
    return instr.groupBy(*BY).agg(
        F.count_if(call).alias("calls"), F.min(F.when(call, pos)).alias("first_call"), F.count_if(is_write(op)).alias("writes"), F.max(F.when(is_write(op), pos)).alias("last_write"),
        F.array_sort(F.collect_set(F.when(op.isin(*READS), F.col("key")))).alias("reads_keys"), F.array_sort(F.collect_set(F.when(is_write(op), F.col("key")))).alias("writes_keys"),
    )


def shared_state(instr: DataFrame) -> DataFrame:
    """(contract, kind, what, severity): several functions that call and write; a function with many of both; a key that
    functions with calls touch more than once; a key read before and written after a call."""
    s = summaries(instr)
    several = s.where("calls > 0 AND writes > 0").groupBy("contract").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("contract", F.lit("several").alias("kind"), F.col("n").cast("string").alias("what"), F.lit("High").alias("severity"))
    many = s.where("calls > 1 AND writes > 2").select("contract", F.lit("many").alias("kind"), F.col("func").alias("what"), F.lit("High").alias("severity"))
    access = instr.where(is_write(F.col("op")) | F.col("op").isin(*READS)).join(s.where("calls > 0").select(*BY, "first_call"), BY)
    touched = access.groupBy("contract", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("contract", F.lit("touched").alias("kind"), F.col("key").alias("what"), F.lit("Medium").alias("severity"))
    around = access.groupBy(*BY, "key").agg(F.min(F.when(F.col("op").isin(*READS), F.col("pos"))).alias("r"), F.max(F.when(is_write(F.col("op")), F.col("pos"))).alias("w"), F.min("first_call").alias("c")).where("r < c AND w > c")
    around = around.select("contract", F.lit("around").alias("kind"), F.concat_ws(":", "func", "key").alias("what"), F.lit("High").alias("severity"))
    return several.unionByName(many).unionByName(touched).unionByName(around)


def time_findings(instr: DataFrame) -> DataFrame:
    """(contract, func, finding_type, severity) by how a function uses the block's time, number and difficulty."""
    op, low, text = F.col("op"), F.lower("func"), F.lower(F.coalesce("message", F.lit("")))
    g = instr.groupBy(*BY).agg(F.count_if(op == "BlockTimestamp").alias("times"), F.count_if(op.isin("BlockNumber", "BlockDifficulty")).alias("numbers"), F.count_if(op.isin("Add", "Sub", "Mul", "Div", "Mod")).alias("sums"), F.max((op == "Require") & text.rlike(SUSPICIOUS) & ~text.rlike(BENIGN)).alias("guards"))
    kinds = F.array(
        F.when((F.col("times") > 0) & low.rlike(RANDOM), F.struct(F.lit("timestamp-randomness").alias("t"), F.lit("High").alias("s"))), F.when((F.col("times") > 0) & ~low.rlike(RANDOM) & F.col("guards"), F.struct(F.lit("timestamp-access-control").alias("t"), F.lit("Medium").alias("s"))),
        F.when((F.col("numbers") > 0) & low.rlike(RANDOM), F.struct(F.lit("block-number-randomness").alias("t"), F.lit("High").alias("s"))), F.when((F.col("times") > 0) & (F.col("sums") > 2), F.struct(F.lit("complex-time-arithmetic").alias("t"), F.lit("Medium").alias("s"))),
    )
    return g.select(*BY, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k")).select(*BY, F.col("k.t").alias("finding_type"), F.col("k.s").alias("severity"))


def price_findings(instr: DataFrame) -> DataFrame:
    """(contract, func, pos, finding_type, severity, confidence): prices from one oracle, not checked for age, deviation or slippage,
    much worked on, used beside many calls; divisions by a value that is made outside of the code.

    A check is a requirement whose message speaks of prices; only such a message can tell of age, deviation or slippage. The
    last two are asked for where there is a check at all, and have no place. Where instr has targets, builtins are no
    oracles; where it has operands, a division counts whose divisor is an instruction's value or a `storage:` reference,
    not a parameter or a constant. pos: the first instruction that a finding is about. One exchange; divisions need none.
    """
    op, low, text = F.col("op"), F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("message", F.lit("")))
    target = F.col("target") if "target" in instr.columns else F.lit(None).cast("string")
    call, product, check = op == "Call", op.isin("Mul", "Div"), (op == "Require") & text.rlike(PRICE)
    oracle = call & ~target.eqNullSafe("Builtin") & F.when(target.eqNullSafe("Internal"), low.rlike(OWN_ORACLE)).otherwise(low.rlike(ORACLE))
    first, said = lambda on: F.min(F.when(on, F.col("pos"))), lambda words: F.max(check & text.rlike(words))
    g = instr.groupBy(*BY).agg(F.count_if(oracle).alias("oracles"), first(oracle).alias("oracle"), F.count_if(call).alias("calls"), first(call).alias("call"), F.count_if(product).alias("products"), first(product).alias("product"), F.count_if(op == "StorageLoad").alias("reads"), F.count_if(check).alias("checks"), said(FRESH).alias("fresh"), said(DEVIATION).alias("deviation"), said(SLIPPAGE).alias("slippage"))
    c, nowhere = F.col, F.lit(None).cast("long")
    row = lambda on, kind, severity, confidence, pos: F.when(on, F.struct(pos.cast("long").alias("pos"), F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    kinds = F.array(
        row(c("oracles") == 1, "single-oracle-dependency", "High", "Medium", c("oracle")), row((c("products") > 3) & (c("reads") > 0), "complex-price-calculation", "Medium", "Medium", c("product")),
        row((c("calls") > 2) & (c("checks") > 0), "flashloan-manipulation-risk", "High", "Medium", c("call")), row((c("oracles") > 0) & ~c("fresh"), "no-oracle-freshness-check", "Medium", "High", c("oracle")),
        row((c("checks") > 0) & ~c("deviation"), "no-price-deviation-check", "Medium", "Medium", nowhere), row((c("checks") > 0) & ~c("slippage"), "no-slippage-protection", "Low", "Medium", nowhere),
    )
    out = g.select(*BY, F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k")).select(*BY, "k.*")
    if "operands" not in instr.columns:
        return out
    divisor = F.get("operands", F.lit(1))
    made = (op == "Div") & divisor.isNotNull() & ~divisor.rlike("^(?:param|const):")
    return out.unionByName(instr.where(made).select(*BY, F.col("pos").cast("long").alias("pos"), F.lit("division-by-manipulable-value").alias("finding_type"), F.lit("Medium").alias("severity"), F.lit("Medium").alias("confidence")))


def dangerous(instr: DataFrame) -> DataFrame:
    """(contract, func, pos, what): dangerous operations, and a row for each dangerous word in the name of what is called."""
    words = F.filter(F.array(*map(F.lit, DANGEROUS)), lambda w: F.contains(F.lower(F.coalesce("name", F.lit(""))), w))
    direct = F.when(F.col("op").isin("DelegateCall", "Selfdestruct"), F.array(F.lower("op"))).otherwise(F.array().cast("array<string>"))
    return instr.select(*BY, "pos", F.explode(F.array_distinct(F.concat(direct, words))).alias("what"))


def state_modifications(instr: DataFrame, most: int = 10) -> DataFrame:
    """(contract, func, stores, first): functions with more than `most` writes to storage."""
    w = instr.where(F.col("op").isin("StorageStore", "MappingStore", "ArrayStore"))
    return w.groupBy(*BY).agg(F.count(F.lit(1)).alias("stores"), F.min("pos").alias("first")).where(F.col("stores") > most)


def located(instr: DataFrame, locations: DataFrame) -> DataFrame:
    """instr with line: where the source says so, else its number among the function's instructions."""
    return instr.join(locations.select(*BY, "pos", F.col("line").alias("known")), [*BY, "pos"], "left").withColumn("line", F.coalesce("known", F.col("idx").cast("long"))).drop("known")


def histogram(instr: DataFrame, by: str = "op", of: str = "func") -> DataFrame:
    return instr.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(of).alias("functions"))


def tainted(moves: DataFrame, seeds: DataFrame, step) -> DataFrame:
    """(func, value): all values that seeds (func, value) reach through moves (func, src, dst), to a fixpoint; step writes a round's rows."""
    seen = step(seeds.select("func", "value").distinct())
    last = seen
    while True:
        new = last.join(moves, (last["func"] == moves["func"]) & (F.col("value") == F.col("src"))).select(moves["func"].alias("func"), F.col("dst").alias("value")).distinct()
        last = step(new.join(seen, ["func", "value"], "left_anti"))
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)


def safe_patterns(instr: DataFrame, functions: DataFrame) -> DataFrame:
    """(contract, func, patterns, score): what protects a function, and the sum of the patterns' weights, one at most."""
    op = F.col("op")
    g = instr.groupBy(*BY).agg(F.min(F.when(is_call(op), F.col("pos"))).alias("call"), F.min(F.when(is_write(op), F.col("pos"))).alias("write"), F.max(F.lower(F.coalesce("name", F.lit(""))).contains("safetransfer")).alias("safe"), F.max(F.lower(F.coalesce("key", F.lit(""))).rlike("lock|mutex")).alias("lock"))
    f = g.join(functions, BY, "left").withColumn("m", F.transform(F.coalesce("modifiers", F.array().cast("array<string>")), lambda x: F.lower(x)))
    has = lambda pattern: F.exists("m", lambda x: x.rlike(pattern))
    found = {"reentrancy-guard": (has("nonreentrant"), 0.9), "checks-effects-interactions": ((F.col("write") < F.col("call")) & F.col("call").isNotNull(), 0.85), "ownable": (has("onlyowner"), 0.8), "safe-erc20": (F.col("safe"), 0.75), "initializer": (has("initializer"), 0.7), "mutex": (F.col("lock"), 0.9)}
    names = F.filter(F.array(*(F.when(on, F.lit(k)) for k, (on, _) in found.items())), lambda x: x.isNotNull())
    score = sum((F.when(on, F.lit(w).cast("float")).otherwise(F.lit(0.0).cast("float")) for on, w in found.values()), F.lit(0.0).cast("float"))
    return f.select(*BY, names.alias("patterns"), F.least(score, F.lit(1.0).cast("float")).alias("score"))


#: Names of calls and what they trigger in the receiver; beginnings of the names of such hooks.
TRIGGERS = (("send", "tokensReceived"), ("operatorSend", "tokensReceived"), ("burn", "tokensToSend"), ("operatorBurn", "tokensToSend"), ("safeTransferFrom", "onERC721Received"), ("safeTransferFrom", "onERC1155Received"), ("safeBatchTransferFrom", "onERC1155BatchReceived"))


def hooks(instr: DataFrame) -> DataFrame:
    """(contract, func, pos, name, hook, writes_after): calls that trigger a hook of the receiver, and whether state is written later."""
    table = F.map_from_entries(F.array(*(F.struct(F.lit(a), F.array(*(F.lit(y) for x, y in TRIGGERS if x == a))) for a in dict.fromkeys(x for x, _ in TRIGGERS))))
    last = F.max(F.when(is_write(F.col("op")), F.col("pos"))).over(Window.partitionBy(*BY))
    hit = instr.withColumn("last_write", last).where(is_call(F.col("op")) & F.col("name").isNotNull()).withColumn("hook", F.explode(F.try_element_at(table, F.col("name"))))
    return hit.select(*BY, "pos", "name", "hook", F.coalesce(F.col("last_write") > F.col("pos"), F.lit(False)).alias("writes_after"))


def placed(instr: DataFrame) -> DataFrame:
    """instr with place: its number over the whole contract, functions in the order of their names. Two levels of counts: a function's
    offset is what the functions before it have, so that no window goes over a contract's instructions."""
    sizes = instr.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))
    offset = sizes.select(*BY, F.coalesce(F.sum("n").over(Window.partitionBy("contract").orderBy("func").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy(*BY).orderBy("pos")) - 1
    return instr.withColumn("own", own).join(offset, BY).withColumn("place", (F.col("offset") + F.col("own")).cast("long")).drop("own", "offset")


def ordering(instr: DataFrame) -> DataFrame:
    """(contract, func, call, place, last_check, last_write, next_write, gap, verdict) of each call that leaves the contract: its
    place over the contract, the nearest check and write before it, the nearest write after it and how far that is.

    verdict: write-after-call, or effects-first if all writes come before, or no-writes. Going back over a function, the
    nearest later write is the last one seen; no frame looks ahead over the rest.
    """
    order = Window.partitionBy(*BY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*BY).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    write, check = F.when(is_write(F.col("op")), F.col("pos")), F.when(F.col("op") == "Require", F.col("pos"))
    seen = placed(instr).withColumns({"last_check": F.last(check, ignorenulls=True).over(order), "last_write": F.last(write, ignorenulls=True).over(order), "next_write": F.last(write, ignorenulls=True).over(back)})
    outside = is_call(F.col("op")) & (~F.col("target").eqNullSafe("Internal") if "target" in instr.columns else F.lit(True))
    verdict = F.when(F.col("next_write").isNotNull(), "write-after-call").when(F.col("last_write").isNotNull(), "effects-first").otherwise("no-writes")
    return seen.where(outside).select(*BY, F.col("pos").alias("call"), "place", "last_check", "last_write", "next_write", (F.col("next_write") - F.col("pos")).alias("gap"), verdict.alias("verdict"))


def as_text(instr: DataFrame) -> DataFrame:
    """(contract, func, text): each function's instructions with their places; a place is the number over the whole contract."""
    line = F.concat(F.lit("["), F.col("place"), F.lit("] "), F.concat_ws(" ", "op", "key", "name"))
    rows = placed(instr).groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("all"))
    return rows.select(*BY, F.concat(F.lit("function "), F.col("func"), F.lit(":\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("text"))


#: What the lines of as_text() look like: a function's, and an instruction's with its place.
HEADER, LINE = r"^function (\S+):$", r"^\[(\d+)\] ([A-Z]\w*)((?: \S+)*)$"


def validated(texts: DataFrame, *, key: str = "file", text_col: str = "text") -> DataFrame:
    """One row for each row of texts: key, elements (functions), instructions, rules (how often each operation, as `op=n` sorted
    and comma-joined), ok, error (`line n: why` of the first fault, or null): are texts as as_text() writes them?

    Faults: a line that is neither a function's nor an instruction's nor blank; an instruction before any function; a place that
    isn't above that of the line before; a function named twice or no function (of the text, without a line). Worked out where a row
    is, in time linear in the text: a line is looked at with the one before it. Null is empty; repeated keys do no harm.
    """
    line = lambda i: F.get("lines", i)
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\r]+(?=\n|$)", ""), "\n")
    head, place, op = lambda x: F.regexp_extract(x, HEADER, 1), lambda x: F.regexp_extract(x, LINE, 1), lambda x: F.regexp_extract(x, LINE, 2)
    t = texts.select(F.col(key), lines.alias("lines")).withColumns({"heads": F.filter(F.transform("lines", head), lambda x: x != ""), "ops": F.filter(F.transform("lines", op), lambda x: x != ""), "top": F.array_position(F.transform("lines", lambda x: head(x) != ""), F.lit(True))})

    def fault(x: Column, i: Column) -> Column:
        before = line(i - 1)
        why = (
            F.when((x == "") | (head(x) != ""), None)
            .when(place(x) == "", "neither a function nor an instruction").when((F.col("top") == 0) | (i < F.col("top") - 1), "an instruction before any function")
            .when((i > 0) & (place(before) != "") & (place(before).cast("decimal(38,0)") >= place(x).cast("decimal(38,0)")), "places that don't rise")
        )
        return F.when(why.isNotNull(), F.concat(F.lit("line "), i + 1, F.lit(": "), why))

    first = F.get(F.filter(F.transform("lines", fault), lambda x: x.isNotNull()), F.lit(0))
    error = F.coalesce(first, F.when(F.size("heads") == 0, "no functions").when(F.size(F.array_distinct("heads")) < F.size("heads"), "a function named twice"))
    used = F.array_sort(F.array_distinct("ops"))
    rules_ = F.array_join(F.transform(used, lambda k: F.concat(k, F.lit("="), F.size(F.filter("ops", lambda x: x == k)))), ",")
    return t.select(F.col(key), F.size("heads").cast("long").alias("elements"), F.size("ops").cast("long").alias("instructions"), rules_.alias("rules"), error.isNull().alias("ok"), error.alias("error"))
