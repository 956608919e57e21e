"""Reentrancy over instructions: across functions by the closure of calls, along paths of the flow, in loops, and all together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import graph, ir
from .defuse import external
from .ir import BY

#: Blocks of a path, and paths taken up in a function; up to so many blocks a path may meet a block again.
LONGEST, MOST, AGAIN = 20, 100, 5
#: Functions that a token's transfer calls in its receiver.
HOOKS = "tokensReceived|tokensToSend|onERC721Received|onERC1155Received|onERC1155BatchReceived"
STORES = ("StorageStore", "MappingStore", "ArrayStore")


def is_store() -> Column:
    return F.col("op").isin(*STORES)


def closure(edges: DataFrame, by: list[str], step=lambda df: written(df, "closure")) -> DataFrame:
    """(by, start, node, depth, path): everything that each start of the edges (by, src, dst) reaches, with one shortest path (the
    least of several). Round by round: the last round's nodes meet the edges, the least path to each new node stays."""
    edges = step(edges.select(*by, "src", "dst").distinct())
    seen = step(edges.select(*by, F.col("src").alias("start"), F.col("src").alias("node"), F.lit(0).cast("long").alias("depth"), F.array("src").alias("path")).distinct())
    last = seen
    while True:
        new = last.join(edges.withColumnRenamed("src", "node"), [*by, "node"]).groupBy(*by, "start", F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"), F.min(F.concat("path", F.array("dst"))).alias("path"))
        last = step(new.join(seen, [*by, "start", "node"], "left_anti"))
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)


def cross_function(instr: DataFrame, edges: DataFrame, step=lambda df: written(df, "closure")) -> DataFrame:
    """(contract, func, other, path, keys, is_hook): a function that calls outside, and one that it reaches by calls within the
    contract and that writes state.

    What func calls directly counts only if its last call comes after the first call outside; what it reaches through others
    counts always. edges: (contract, caller, callee, pos, is_external), as from ir.call_edges(); keys: what other writes.
    """
    inside = edges.where("NOT is_external")
    leaving = instr.where(external()).groupBy(*BY).agg(F.min("pos").alias("first"))
    called = inside.groupBy("contract", F.col("caller").alias("func"), F.col("callee").alias("other")).agg(F.max("pos").alias("called"))
    writes = instr.where(is_store()).groupBy("contract", F.col("func").alias("other")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    reach = closure(inside.select("contract", F.col("caller").alias("src"), F.col("callee").alias("dst")), ["contract"], step).where("depth > 0")
    pairs = reach.select("contract", F.col("start").alias("func"), F.col("node").alias("other"), "path").join(leaving, BY).join(writes, ["contract", "other"]).join(called, [*BY, "other"], "left")
    return pairs.where("called IS NULL OR called > first").select(*BY, "other", "path", "keys", F.col("other").rlike(f"^(?:{HOOKS})").alias("is_hook"))


def explored(successors: DataFrame, by: list[str], step=lambda df: written(df, "paths")) -> DataFrame:
    """(by, n, path): the complete paths of each function, in the order n in which a search breadth first completes them.

    successors: (by, block, next): the blocks after each block, in order (an empty array: the function ends); the least block
    is the entry. MOST paths are taken up in a function, LONGEST blocks is a path's length; a block comes again only in paths
    of under AGAIN blocks. A path of LONGEST blocks is complete for each successor it could go on to. A round takes up all
    paths of one length of all functions; the number of a path is what was taken up before it.
    """
    flow = step(successors.select(*by, "block", "next"))
    now = flow.groupBy(*by).agg(F.array(F.min("block")).alias("path")).withColumn("n", F.lit(1).cast("long"))
    done = []
    for length in range(1, LONGEST + 1):
        # a shuffle for each round, as what is sent to all tasks would add up over the rounds
        met = now.withColumn("block", F.element_at("path", -1)).hint("merge").join(flow, [*by, "block"]).drop("block")
        at = step(met.withColumn("before", F.max("n").over(Window.partitionBy(*by))))
        if at.isEmpty():
            break
        done.append(at.where("size(next) = 0").select(*by, "n", F.lit(0).alias("turn"), "path"))
        on = at.select(*by, "n", "before", "path", F.posexplode("next").alias("turn", "to"))
        on = on if length < AGAIN else on.where(~F.array_contains("path", F.col("to")))
        if length == LONGEST:
            done.append(on.select(*by, "n", "turn", "path"))
            break
        numbers = F.row_number().over(Window.partitionBy(*by).orderBy("n", "turn")).cast("long")
        now = on.withColumn("n", F.col("before") + numbers).where(F.col("n") <= MOST).select(*by, F.concat("path", F.array("to")).alias("path"), "n")
    every = reduce(DataFrame.unionByName, done)
    return every.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("n", "turn")).cast("long").alias("n"), "path")


def conditional(paths: DataFrame, instr: DataFrame) -> DataFrame:
    """(contract, func, call, write, parts_at): each external call and each store of a function that lie on explored paths (all
    begin at the entry, so that one can follow the other), with the last block that the first path of the call and the first
    path of the store have in common before they part; null if these are one path. paths: (contract, func, n, path)."""
    first = paths.select(*BY, "n", "path", F.explode(F.array_distinct("path")).alias("block")).groupBy(*BY, "block").agg(F.min_by("path", "n").alias("path"))
    on = instr.join(first, [*BY, "block"])
    calls = on.where(external()).select(*BY, F.col("pos").alias("call"), F.col("path").alias("p"))
    writes = on.where(is_store()).select(*BY, F.col("pos").alias("write"), F.col("path").alias("q"))
    shorter = F.least(F.size("p"), F.size("q"))
    differ = F.array_position(F.zip_with(F.slice("p", F.lit(1), shorter), F.slice("q", F.lit(1), shorter), lambda x, y: x == y), F.lit(False))
    parts = F.when(differ > 1, F.get("p", (differ - 2).cast("int"))).when((differ == 0) & (F.size("p") != F.size("q")), F.get("p", shorter - 1))
    return calls.join(writes, BY).select(*BY, "call", "write", parts.alias("parts_at"))


def in_loops(instr: DataFrame, edges: DataFrame) -> DataFrame:
    """(contract, func, header, calls, writes): natural loops with external calls in the body and stores in blocks after an exit.
    edges: (contract, func, src, dst) of blocks."""
    found = graph.loops(edges, BY)
    calls = found.select(*BY, "header", F.explode("body").alias("block")).join(instr.where(external()), [*BY, "block"]).groupBy(*BY, "header").agg(F.array_sort(F.collect_list("pos")).alias("calls"))
    after = graph.writes_after(found, edges, instr.where(is_store()).select(*BY, "block").distinct(), BY)
    return calls.join(after, [*BY, "header"])


def guarded(instr: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions with a guard or a lock whose safe patterns sum to more than 0.9."""
    safe = ir.safe_patterns(instr, functions).where(F.arrays_overlap("patterns", F.array(F.lit("reentrancy-guard"), F.lit("mutex"))))
    return safe.where(F.round(F.col("score").cast("double"), 4) > 0.9).select(*BY)


def reentrancy(instr: DataFrame, functions: DataFrame, edges: DataFrame, successors: DataFrame, step=lambda df: written(df, "reentrancy")) -> DataFrame:
    """(contract, func, finding_type, at, what): all kinds of reentrancy in functions that no guard protects, in one relation.

    reentrancy: a store (what) after an external call (at), later in its block or in a later block; cross-function-reentrancy:
    what is the other function, at the first call; loop-reentrancy: what is the loop's first store block, at its first call;
    conditional-reentrancy: as conditional(); reentrancy-pattern: the first store after each call. instr is written once and
    read by all five.
    """
    open_ = step(instr.join(guarded(instr, functions), BY, "left_anti"))
    calls = open_.where(external()).select(*BY, "block", F.col("pos").alias("at"))
    writes = open_.where(is_store()).select(*BY, F.col("block").alias("to"), F.col("pos").alias("w"))
    row = lambda df, kind, at, what: df.select(*BY, F.lit(kind).alias("finding_type"), F.col(at).alias("at"), F.col(what).cast("string").alias("what"))
    direct = calls.join(writes, BY).where("(block = to AND w > at) OR block < to")
    later = F.first(F.when(is_store(), F.col("pos")), ignorenulls=True).over(Window.partitionBy(*BY).orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    pattern = open_.withColumn("w", later).where(external() & F.col("w").isNotNull())
    # other functions keep their state changes, whether guarded or not: only where the calls begin is a guard of use
    cross = cross_function(instr, edges, step).join(open_.select(*BY).distinct(), BY, "left_semi").join(calls.groupBy(*BY).agg(F.min("at").alias("at")), BY)
    blocks = successors.select(*BY, F.col("block").alias("src"), F.explode("next").alias("dst"))
    loop = in_loops(open_, blocks).withColumn("at", F.array_min("calls")).withColumn("w", F.array_min("writes"))
    paths = conditional(explored(successors.join(open_.select(*BY).distinct(), BY, "left_semi"), BY, step), open_)
    rows = [row(direct, "reentrancy", "at", "w"), row(cross, "cross-function-reentrancy", "at", "other"), row(loop, "loop-reentrancy", "at", "w"), row(paths, "conditional-reentrancy", "call", "write"), row(pattern, "reentrancy-pattern", "pos", "w")]
    return reduce(DataFrame.unionByName, rows)
