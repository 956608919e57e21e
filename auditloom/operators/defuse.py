"""Values of instructions: who uses which, what a value comes from, and the detectors that look at operands.

Instructions as in ir, with three columns more: value (what it makes, or null), operands (array of values, `param:` and `const:`
before those of parameters and constants; of an access to a mapping or an array the first one is the key, of Require the
condition) and target (of calls: External, Internal, Library or Builtin).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .ir import BY, CRITICAL, PERMISSION, SELF_SERVICE, TRIVIAL

#: Operations that change a value's type only; that compare; that take values from outside; pure ones.
CASTS = ("Cast", "ZeroExtend", "SignExtend", "Truncate")
EQUALITIES, JOINTS = ("Eq", "Ne"), ("Eq", "Ne", "And", "Or")
CONTEXT = ("MsgSender", "TxOrigin", "BlockTimestamp", "BlockNumber", "BlockDifficulty")
LOADS = ("StorageLoad", "MappingLoad")
PURE = (*CASTS, "Add", "Sub", "Mul", "Div", "Mod", "And", "Or", "Eq", "Ne", "Lt", "Gt", "Le", "Ge")
#: What a message says of a checked call.
CALL_CHECKED = "failed|success|transfer|call"


def external(instr_op: Column | None = None) -> Column:
    """Calls that leave the contract."""
    op = F.col("op") if instr_op is None else instr_op
    return (op == "DelegateCall") | ((op == "Call") & (F.col("target") == "External"))


def uses(instr: DataFrame) -> DataFrame:
    """(contract, func, pos, block, op, value, slot, operand): a row for each operand of each instruction."""
    return instr.select(*BY, "pos", "block", "op", "value", F.posexplode("operands").alias("slot", "operand")).where("operand is not null")


def reached(instr: DataFrame, seeds: DataFrame, through: tuple[str, ...], step=lambda df: written(df, "reached")) -> DataFrame:
    """(contract, func, value): seeds (contract, func, value) and all values made from them by operations `through`, to a fixpoint.
    Each round joins the last round's values alone with the uses; step writes a round's rows."""
    moves = step(uses(instr.where(F.col("op").isin(*through) & F.col("value").isNotNull())).select(*BY, "operand", "value").distinct())
    seen = step(seeds.select(*BY, "value").distinct())
    last = seen
    while True:
        new = last.withColumnRenamed("value", "operand").join(moves, [*BY, "operand"]).select(*BY, "value").distinct()
        last = step(new.join(seen, [*BY, "value"], "left_anti"))
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)


def senders(instr: DataFrame, step=lambda df: written(df, "senders")) -> DataFrame:
    """Values that are the caller, through changes of type."""
    return reached(instr, instr.where("op = 'MsgSender'"), CASTS, step)


def constants(instr: DataFrame, step=lambda df: written(df, "constants")) -> DataFrame:
    """(contract, func, value): results of pure operations all of whose operands are constants, to a fixpoint. Each round looks
    at those instructions alone that use a value of the last one."""
    u = step(uses(instr.where(F.col("op").isin(*PURE) & F.col("value").isNotNull())).select(*BY, "value", "slot", "operand"))
    fixed = F.col("operand").startswith("const:")
    seen = step(u.groupBy(*BY, "value").agg(F.count_if(~fixed).alias("open")).where("open = 0").select(*BY, "value"))
    last = seen
    while True:
        touched = last.withColumnRenamed("value", "operand").join(u, [*BY, "operand"]).select(*BY, "value").distinct()
        known = seen.select(*BY, F.col("value").alias("operand"), F.lit(True).alias("known"))
        now = u.join(touched, [*BY, "value"], "left_semi").join(known, [*BY, "operand"], "left")
        new = now.groupBy(*BY, "value").agg(F.count_if(~fixed & F.col("known").isNull()).alias("open")).where("open = 0").select(*BY, "value")
        last = step(new.join(seen, [*BY, "value"], "left_anti"))
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)


def access_control(instr: DataFrame, functions: DataFrame, step=lambda df: written(df, "senders")) -> DataFrame:
    """(contract, func, pos, finding_type, severity, confidence): open functions that change state without a check, and each
    look at the transaction's origin in those with one.

    State is changed by stores, external calls and self-destruction, but not by a store to a mapping or an array under the
    caller's own key. A check is a requirement, a comparison with the caller, or a load of a mapping under the caller's key.
    """
    sender = senders(instr, step).withColumn("own", F.lit(True))
    keyed = instr.withColumn("k", F.when(F.col("op").isin("MappingLoad", "MappingStore", "ArrayStore"), F.get("operands", F.lit(0))))
    keyed = keyed.join(sender.withColumnRenamed("value", "k"), [*BY, "k"], "left")
    compared = uses(instr.where("op = 'Eq'")).join(sender.select(*BY, F.col("value").alias("operand")), [*BY, "operand"], "left_semi").select(*BY).distinct().withColumn("compared", F.lit(True))
    op, own = F.col("op"), F.col("own").isNotNull()
    call, store = (op == "Call") & (F.col("target") == "External"), op == "StorageStore"
    changes = store | call | (op == "Selfdestruct") | (op.isin("MappingStore", "ArrayStore") & ~own)
    g = keyed.groupBy(*BY).agg(
        F.count_if(changes).alias("mods"), F.min(F.when(changes, F.col("pos"))).alias("pos"), F.coalesce(F.max(store), F.lit(False)).alias("stores"), F.coalesce(F.max(call | (op == "Selfdestruct")), F.lit(False)).alias("leaves"),
        F.coalesce(F.max((op == "Require") | ((op == "MappingLoad") & own)), F.lit(False)).alias("required"), F.array_sort(F.collect_list(F.when(op == "TxOrigin", F.col("pos")))).alias("origins"),
    )
    f = g.join(functions.where(F.col("visibility").isin("public", "external")), BY).where("mods > 0").where(F.size("modifiers") == 0).join(compared, BY, "left")
    low = F.lower("func")
    own_service, critical, maker = low.rlike(SELF_SERVICE), low.rlike(CRITICAL), low.rlike("constructor|init")
    severity = F.when(own_service, "Low").when(F.col("leaves") | (critical & F.col("stores")), "High").when(critical | (F.col("mods") > 2), "Medium").otherwise("Low")
    confidence = F.when((F.col("mods") > 1) & ~maker & ~own_service, "High").when(~maker & ~own_service, "Medium").otherwise("Low")
    trivial = ~F.col("leaves") & ~F.col("stores") & ~low.rlike(PERMISSION) & (low.rlike(TRIVIAL) | ((F.col("mods") == 1) & ~low.contains("set")))
    checked = F.col("required") | F.col("compared").isNotNull()
    missing = f.where(~checked & ~trivial).select(*BY, "pos", F.lit("missing-access-control").alias("finding_type"), severity.alias("severity"), confidence.alias("confidence"))
    weak = f.where(checked).select(*BY, F.explode("origins").alias("pos"), F.lit("weak-access-control-tx-origin").alias("finding_type"), F.lit("Medium").alias("severity"), F.lit("High").alias("confidence"))
    return missing.unionByName(weak)


def unchecked_returns(instr: DataFrame) -> DataFrame:
    """(contract, func, pos, name) of external calls whose result nothing looks at.

    A call is checked by a requirement of its block before the block's next external call, if its message speaks of calls or
    its condition is the result or joins it with something; or by an equality anywhere that has the result as an operand.
    """
    calls = instr.where((F.col("op") == "Call") & ((F.col("target") == "External") | ((F.col("target") == "Internal") & F.coalesce("name", F.lit("")).contains("call"))))
    leaves = (F.col("op") == "Call") & (F.col("target") == "External")
    w = Window.partitionBy(*BY, "block").orderBy(F.desc("pos"))
    # going back over a block: the requirements between a call and the next external one are those gathered since
    turn = F.count_if(leaves).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = instr.withColumn("turn", turn)
    req = parts.where("op = 'Require'").select(*BY, "block", "turn", F.col("pos").alias("at"), F.get("operands", F.lit(0)).alias("condition"), F.lower(F.coalesce("message", F.lit(""))).rlike(CALL_CHECKED).alias("said"))
    mine = parts.join(calls.select(*BY, "pos"), [*BY, "pos"], "left_semi").select(*BY, "block", "turn", "pos", "value")
    near = mine.join(req, [*BY, "block", "turn"]).where("at > pos")
    joint = uses(instr.where(F.col("op").isin(*JOINTS))).select(*BY, F.col("value").alias("condition"), F.col("operand").alias("value")).distinct()
    by_message = near.where("said or condition = value").select(*BY, "pos")
    by_joint = near.join(joint, [*BY, "condition", "value"], "left_semi").select(*BY, "pos")
    compared = uses(instr.where(F.col("op").isin(*EQUALITIES))).select(*BY, F.col("operand").alias("value")).distinct()
    by_value = mine.join(compared, [*BY, "value"], "left_semi").select(*BY, "pos")
    return calls.join(reduce(DataFrame.unionByName, (by_message, by_joint, by_value)), [*BY, "pos"], "left_anti").select(*BY, "pos", "name")


def overflows(instr: DataFrame, looped: DataFrame) -> DataFrame:
    """(contract, func, pos, op, severity, confidence) of sums, differences and products of data from outside: a parameter, a
    load, the result of an external call, the block or the caller. looped: (contract, func, block) of loops."""
    source = instr.where((F.col("op").isin(*CONTEXT, *LOADS) | ((F.col("op") == "Call") & (F.col("target") == "External"))) & F.col("value").isNotNull()).select(*BY, F.col("value").alias("operand"), F.lit(True).alias("outside"))
    u = uses(instr.where(F.col("op").isin("Add", "Sub", "Mul"))).join(source.distinct(), [*BY, "operand"], "left").where(F.col("outside").isNotNull() | F.col("operand").startswith("param:"))
    hit = u.select(*BY, "pos", "block", "op").distinct().join(looped.select(*BY, "block").distinct().withColumn("loop", F.lit(True)), [*BY, "block"], "left")
    loop = F.col("loop").isNotNull()
    severity = F.when(F.col("op") == "Sub", "High").when((F.col("op") == "Mul") & loop, "High").otherwise("Medium")
    return hit.select(*BY, "pos", "op", severity.alias("severity"), F.when(loop, "High").otherwise("Medium").alias("confidence"))


#: How arithmetic is written, by operation; names of calls that send value.
ARITHMETIC = {"Add": "add", "Sub": "sub", "Mul": "mul", "Div": "div", "CheckedAdd": "checked_add", "CheckedSub": "checked_sub", "CheckedMul": "checked_mul", "CheckedDiv": "checked_div"}
SENDING = ("send", "transfer", "call")


def found_in_focus(instr: DataFrame) -> DataFrame:
    """(contract, func, focus, kind, block, pos, text): what an analysis of each focus is shown of a function, in one relation.

    reentrancy: calls outside and writes; access: requirements with condition and message, and operations that need one;
    arithmetic: operations with operands, plain or checked; returns: results of calls outside, used or not. An instruction
    gives a row for each focus that looks at it; only whether a result is used needs a join, of calls with used values.
    """
    used = uses(instr).select(*BY, F.col("operand").alias("value")).distinct().withColumn("used", F.lit(True))
    calls = instr.where((F.col("op") == "Call") & (F.col("target") == "External"))
    returns = calls.join(used, [*BY, "value"], "left").select(*BY, F.lit("returns").alias("focus"), F.when(F.col("used").isNotNull(), "used").otherwise("unused").alias("kind"), "block", "pos", F.coalesce("name", F.lit("")).alias("text"))
    op, operand = F.col("op"), lambda k: F.coalesce(F.get("operands", F.lit(k)), F.lit(""))
    row = lambda on, focus, kind, text: F.when(on, F.struct(F.lit(focus).alias("focus"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text")))
    store, name = op.isin("StorageStore", "MappingStore", "ArrayStore"), F.coalesce("name", F.lit(""))
    math = F.element_at(F.create_map(*(F.lit(x) for kv in ARITHMETIC.items() for x in kv)), op)
    rows = F.array(
        row(external(), "reentrancy", "call", F.concat_ws(" ", op, "name")), row(store, "reentrancy", "write", F.concat_ws(" ", op, "key")),
        row(op.isin("Require", "Assert"), "access", "check", F.concat(F.lit("require("), operand(0), F.lit("): "), F.coalesce("message", F.lit("")))),
        row(op == "StorageStore", "access", "sensitive", F.lit("Storage modification")), row(op == "Selfdestruct", "access", "sensitive", F.lit("Self destruct")), row((op == "Call") & name.isin(*SENDING), "access", "sensitive", F.concat(F.lit("Value transfer to "), name)),
        row(op.isin(*ARITHMETIC), "arithmetic", F.when(op.startswith("Checked"), "checked").otherwise("plain"), F.concat(math, F.lit("("), operand(0), F.lit(", "), operand(1), F.lit(")"))),
    )
    each = instr.select(*BY, "block", "pos", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r"))
    return each.select(*BY, "r.focus", "r.kind", "block", "pos", "r.text").unionByName(returns)
