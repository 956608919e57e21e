"""Queries of the operators on instructions: a user of the table events is a function, an event one of its instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, ir
from ..sources.tables import written
from . import bindings as B

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NAMES = ("withdraw", "drawWinner", "setPrice", "mint", "getRate", "sweep", "transferOwner", "test")
CLICKS = ("Require", "Mul", "BlockTimestamp", "Add", "TxOrigin", "Div")
CALLED = ("oracle", "mint3", "selfdestructAll", "send", "priceFeed", "safeTransferFrom")
MESSAGES = ("owner only", "price stale", "deadline passed", "slippage of the rate")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def instr(spark: SparkSession, d: str) -> DataFrame:
    e, u, k = B.table(spark, d, "events"), F.col("user_id"), F.col("event_id")
    kind = F.col("event_type")
    op = F.when(kind == "error", F.when(k % 4 == 0, "DelegateCall").otherwise("Call")).when(kind == "purchase", "StorageStore").when(kind == "view", "StorageLoad").when(kind == "click", B.chosen(CLICKS, k)).otherwise("BlockNumber")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    out = e.select(F.concat(F.lit("K"), F.pmod(u, F.lit(5))).alias("contract"), F.concat(B.chosen(NAMES, u), u.cast("string")).alias("func"), idx.cast("long").alias("idx"), op.alias("op"), k.alias("event_id"), kind.alias("kind"))
    return out.select("contract", "func", F.expr("idx div 10").alias("block"), "idx", F.col("idx").alias("pos"), "op", F.when(F.col("kind").isin("purchase", "view"), F.concat(F.lit("slot"), k % 5)).alias("key"),
                      F.when(F.col("kind") == "error", B.chosen(CALLED, k)).alias("name"), F.when(F.col("op") == "Require", B.chosen(MESSAGES, F.expr("event_id div 6"))).alias("message"), "event_id")


def functions(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    mods = F.when(u % 7 == 0, F.array(F.lit("onlyOwner"))).when(u % 7 == 1, F.array(F.lit("nonReentrant"))).otherwise(F.array().cast("array<string>"))
    return B.table(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("K"), F.pmod(u, F.lit(5))).alias("contract"), F.concat(B.chosen(NAMES, u), u.cast("string")).alias("func"), B.chosen(B.VISIBILITY, u).alias("visibility"), mods.alias("modifiers"))


SQL = f"""raw AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 'K' || user_id % 5 AS contract, {B.sql_chosen(NAMES, 'user_id')} || user_id AS func FROM events),
o AS (SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'DelegateCall' ELSE 'Call' END WHEN 'purchase' THEN 'StorageStore' WHEN 'view' THEN 'StorageLoad' WHEN 'click' THEN {B.sql_chosen(CLICKS, 'event_id')} ELSE 'BlockNumber' END AS op FROM raw),
instr AS (SELECT contract, func, idx, idx AS pos, op, event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'slot' || event_id % 5 END AS key, CASE WHEN event_type = 'error' THEN {B.sql_chosen(CALLED, 'event_id')} END AS name, CASE WHEN op = 'Require' THEN {B.sql_chosen(MESSAGES, 'event_id // 6')} END AS message, op IN ('Call', 'DelegateCall') AS c, op = 'StorageStore' AS w, op = 'StorageLoad' AS r FROM o),
fn AS (SELECT DISTINCT 'K' || user_id % 5 AS contract, {B.sql_chosen(NAMES, 'user_id')} || user_id AS func, {B.sql_chosen(B.VISIBILITY, 'user_id')} AS visibility, CASE user_id % 7 WHEN 0 THEN 'onlyOwner' WHEN 1 THEN 'nonReentrant' ELSE '' END AS modifier FROM events),
s AS (SELECT contract, func, count(*) FILTER (c) AS calls, min(pos) FILTER (c) AS first_call, count(*) FILTER (w) AS writes, max(pos) FILTER (w) AS last_write FROM instr GROUP BY 1, 2)"""


@query(f"""WITH {SQL} SELECT s.contract, s.func, calls, first_call, writes, last_write, coalesce((SELECT string_agg(DISTINCT key, ',' ORDER BY key) FROM instr i WHERE i.func = s.func AND r), '') AS reads_keys, coalesce((SELECT string_agg(DISTINCT key, ',' ORDER BY key) FROM instr i WHERE i.func = s.func AND w), '') AS writes_keys FROM s""")
def td_ir_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = ir.summaries(instr(spark, d))
    return s.withColumns({c: F.array_join(c, ",") for c in ("reads_keys", "writes_keys")})


@query(f"""WITH {SQL} SELECT DISTINCT i.contract, i.func AS caller, coalesce(f.func, i.name) AS callee, pos, f.func IS NULL AS is_external FROM instr i LEFT JOIN fn f ON f.contract = i.contract AND (f.func = i.name OR (starts_with(i.name, f.func) AND regexp_full_match(substr(i.name, length(f.func) + 1), '_[\\p{{L}}\\p{{N}}_]*'))) WHERE c""")
def td_ir_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return ir.call_edges(instr(spark, d), functions(spark, d))


@query(f"""WITH {SQL}, t AS (SELECT i.contract, i.func, i.key, i.pos, i.r, i.w, first_call FROM instr i JOIN s USING (func) WHERE (i.r OR i.w) AND calls > 0)
SELECT contract, 'several' AS kind, CAST(count(*) AS VARCHAR) AS what, 'High' AS severity FROM s WHERE calls > 0 AND writes > 0 GROUP BY contract HAVING count(*) >= 2 UNION ALL SELECT contract, 'many', func, 'High' FROM s WHERE calls > 1 AND writes > 2
UNION ALL SELECT contract, 'touched', key, 'Medium' FROM t GROUP BY contract, key HAVING count(*) > 1 UNION ALL SELECT contract, 'around', func || ':' || key, 'High' FROM t GROUP BY contract, func, key HAVING min(pos) FILTER (r) < min(first_call) AND max(pos) FILTER (w) > min(first_call)""")
def td_ir_shared_state(spark: SparkSession, d: str) -> DataFrame:
    return ir.shared_state(instr(spark, d))


@query(f"""WITH {SQL}, g AS (SELECT contract, func, lower(func) AS low, count(*) FILTER (op = 'BlockTimestamp') AS t, count(*) FILTER (op = 'BlockNumber') AS n, count(*) FILTER (op IN ('Add', 'Mul', 'Div')) AS a, coalesce(bool_or(op = 'Require' AND message LIKE '%owner%'), false) AS q FROM instr GROUP BY 1, 2)
SELECT contract, func, 'timestamp-randomness' AS finding_type, 'High' AS severity FROM g WHERE t > 0 AND low LIKE '%winner%' UNION ALL SELECT contract, func, 'timestamp-access-control', 'Medium' FROM g WHERE t > 0 AND q AND low NOT LIKE '%winner%' UNION ALL SELECT contract, func, 'block-number-randomness', 'High' FROM g WHERE n > 0 AND low LIKE '%winner%' UNION ALL SELECT contract, func, 'complex-time-arithmetic', 'Medium' FROM g WHERE t > 0 AND a > 2""")
def td_ir_time(spark: SparkSession, d: str) -> DataFrame:
    return ir.time_findings(instr(spark, d))


@query(f"""WITH {SQL}, k AS (SELECT *, op = 'Call' AS call, op = 'Call' AND name IN ('oracle', 'priceFeed') AND event_id % 5 <> 3 AS ora, op IN ('Mul', 'Div') AS prod, op = 'Require' AND message IN ('price stale', 'slippage of the rate') AS chk FROM instr),
g AS (SELECT contract, func, count(*) FILTER (ora) AS o, min(pos) FILTER (ora) AS o1, count(*) FILTER (call) AS c, min(pos) FILTER (call) AS c1, count(*) FILTER (prod) AS p, min(pos) FILTER (prod) AS p1, count(*) FILTER (r) AS rd, count(*) FILTER (chk) AS k, count(*) FILTER (chk AND message = 'price stale') AS fresh, count(*) FILTER (chk AND message LIKE 'slip%') AS slip FROM k GROUP BY 1, 2)
SELECT contract, func, o1 AS pos, 'single-oracle-dependency' AS finding_type, 'High' AS severity, 'Medium' AS confidence FROM g WHERE o = 1 UNION ALL SELECT contract, func, p1, 'complex-price-calculation', 'Medium', 'Medium' FROM g WHERE p > 3 AND rd > 0 UNION ALL SELECT contract, func, c1, 'flashloan-manipulation-risk', 'High', 'Medium' FROM g WHERE c > 2 AND k > 0
UNION ALL SELECT contract, func, o1, 'no-oracle-freshness-check', 'Medium', 'High' FROM g WHERE o > 0 AND fresh = 0 UNION ALL SELECT contract, func, NULL, 'no-price-deviation-check', 'Medium', 'Medium' FROM g WHERE k > 0 UNION ALL SELECT contract, func, NULL, 'no-slippage-protection', 'Low', 'Medium' FROM g WHERE k > 0 AND slip = 0
UNION ALL SELECT contract, func, pos, 'division-by-manipulable-value', 'Medium', 'Medium' FROM instr WHERE op = 'Div' AND event_id % 4 < 2""")
def td_ir_price(spark: SparkSession, d: str) -> DataFrame:
    """Divisors are an earlier value, a storage slot, a constant or a parameter; every fifth call is a builtin."""
    k = F.col("event_id")
    divisor = F.when(k % 4 == 0, F.concat(F.lit("v"), F.col("idx"))).when(k % 4 == 1, "storage:total").when(k % 4 == 2, "const:100").otherwise("param:0")
    i = instr(spark, d).withColumns({"target": F.when(k % 5 == 3, "Builtin").when(k % 5 == 2, "Internal").otherwise("External"), "operands": F.array(F.lit("param:1"), divisor)})
    return ir.price_findings(i)


@query(f"""WITH {SQL} SELECT contract, func, pos, 'delegatecall' AS what FROM instr WHERE op = 'DelegateCall' UNION ALL SELECT contract, func, pos, 'selfdestruct' FROM instr WHERE name = 'selfdestructAll'""")
def td_ir_dangerous(spark: SparkSession, d: str) -> DataFrame:
    return ir.dangerous(instr(spark, d))


@query(f"""WITH {SQL} SELECT contract, func, count(*) AS stores, min(pos) AS first FROM instr WHERE w GROUP BY 1, 2 HAVING count(*) > 10""")
def td_ir_state_modifications(spark: SparkSession, d: str) -> DataFrame:
    return ir.state_modifications(instr(spark, d))


@query(f"""WITH {SQL} SELECT contract, func, pos, name, unnest(CASE name WHEN 'send' THEN ['tokensReceived'] ELSE ['onERC721Received', 'onERC1155Received'] END) AS hook, coalesce(last_write > pos, false) AS writes_after FROM instr JOIN s USING (contract, func) WHERE name IN ('send', 'safeTransferFrom')""")
def td_ir_hooks(spark: SparkSession, d: str) -> DataFrame:
    return ir.hooks(instr(spark, d))


@query(f"""WITH {SQL}, g AS (SELECT contract, func, min(pos) FILTER (c) AS c1, min(pos) FILTER (w) AS w1, coalesce(bool_or(name = 'safeTransferFrom'), false) AS safe FROM instr GROUP BY 1, 2), p AS (SELECT contract, func, modifier = 'nonReentrant' AS a, coalesce(w1 < c1, false) AS b, modifier = 'onlyOwner' AS o, safe FROM g JOIN fn USING (contract, func))
SELECT contract, func, concat_ws(',', CASE WHEN a THEN 'reentrancy-guard' END, CASE WHEN b THEN 'checks-effects-interactions' END, CASE WHEN o THEN 'ownable' END, CASE WHEN safe THEN 'safe-erc20' END) AS patterns, CAST(round(least(1.0, CASE WHEN a THEN 0.9 ELSE 0 END + CASE WHEN b THEN 0.85 ELSE 0 END + CASE WHEN o THEN 0.8 ELSE 0 END + CASE WHEN safe THEN 0.75 ELSE 0 END), 4) AS DOUBLE) AS score FROM p""")
def td_ir_safe_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = ir.safe_patterns(instr(spark, d), functions(spark, d))
    return p.select("contract", "func", F.array_join("patterns", ",").alias("patterns"), F.round(F.col("score").cast("double"), 4).alias("score"))


@query(f"""WITH {SQL} SELECT contract, func, pos, CASE WHEN event_id % 3 = 0 THEN event_id ELSE idx END AS line FROM instr""")
def td_ir_locations(spark: SparkSession, d: str) -> DataFrame:
    """A third of the instructions have a line in the source."""
    i = instr(spark, d)
    return ir.located(i, i.where("event_id % 3 = 0").select("contract", "func", "pos", F.col("event_id").alias("line"))).select("contract", "func", "pos", "line")


@query(f"""WITH {SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY func, pos) - 1 AS place FROM instr) SELECT contract, func, md5('function ' || func || ':' || chr(10) || string_agg('[' || place || '] ' || concat_ws(' ', op, key, name), chr(10) ORDER BY place)) AS text FROM n GROUP BY 1, 2""")
def td_ir_text(spark: SparkSession, d: str) -> DataFrame:
    return ir.as_text(instr(spark, d)).withColumn("text", F.md5("text"))


@query(f"""WITH {SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY func, pos) - 1 AS place FROM instr), x AS (SELECT func, count(*) AS instructions, max(place) AS last FROM n GROUP BY 1),
m AS (SELECT func, string_agg(op || '=' || k, ',' ORDER BY op) AS rules FROM (SELECT func, op, count(*) AS k FROM n GROUP BY 1, 2) GROUP BY 1)
SELECT func, CASE last % 5 WHEN 1 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS elements, instructions + CASE last % 5 WHEN 0 THEN 1 ELSE 0 END AS instructions, rules || CASE last % 5 WHEN 0 THEN ',Zero=1' ELSE '' END AS rules, last % 5 = 4 AS ok,
CASE last % 5 WHEN 0 THEN 'line ' || instructions + 2 || ': places that don''t rise' WHEN 1 THEN 'line 1: neither a function nor an instruction' WHEN 2 THEN 'line ' || instructions + 2 || ': neither a function nor an instruction' WHEN 3 THEN 'a function named twice' END AS error FROM x JOIN m USING (func)""")
def td_ir_validate(spark: SparkSession, d: str) -> DataFrame:
    """Listings of functions, four of five spoilt by the last place in them: a place again at the end, no colon after the name, a line
    of something else, the first line again."""
    t = ir.as_text(instr(spark, d)).withColumn("last", F.regexp_extract("text", r"\[(\d+)\][^\n]*$", 1).cast("long"))
    n = F.col("last") % 5
    spoilt = F.when(n == 0, F.concat("text", F.lit("\n["), "last", F.lit("] Zero"))).when(n == 1, F.regexp_replace("text", r"^([^\n]*):", "$1")).when(n == 2, F.concat("text", F.lit("\n; end")))
    spoilt = spoilt.when(n == 3, F.concat("text", F.lit("\n\nfunction "), "func", F.lit(":"))).otherwise(F.col("text"))
    return ir.validated(t.select("func", spoilt.alias("text")), key="func")


@query(f"""WITH {SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY func, pos) - 1 AS place FROM instr),
z AS (SELECT contract, func, pos AS call, place, (SELECT max(pos) FROM instr i WHERE i.func = n.func AND i.op = 'Require' AND i.pos < n.pos) AS last_check, (SELECT max(pos) FROM instr i WHERE i.func = n.func AND i.w AND i.pos < n.pos) AS last_write, (SELECT min(pos) FROM instr i WHERE i.func = n.func AND i.w AND i.pos > n.pos) AS next_write FROM n WHERE c)
SELECT *, next_write - call AS gap, CASE WHEN next_write IS NOT NULL THEN 'write-after-call' WHEN last_write IS NOT NULL THEN 'effects-first' ELSE 'no-writes' END AS verdict FROM z""")
def td_ir_ordering(spark: SparkSession, d: str) -> DataFrame:
    return ir.ordering(instr(spark, d))


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS func, 1 AS value FROM lineitem WHERE l_linenumber = 1 UNION SELECT func, l_linenumber + 1 FROM w JOIN lineitem ON l_orderkey = func AND l_linenumber = value WHERE l_returnflag <> 'R') SELECT func, count(*) AS n FROM w GROUP BY 1""")
def td_ir_taint(spark: SparkSession, d: str) -> DataFrame:
    """Values that the first one of an order reaches through its lines that aren't returned."""
    l = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("func"), "l_linenumber", "l_returnflag")
    moves = l.where("l_returnflag <> 'R'").select("func", F.col("l_linenumber").alias("src"), (F.col("l_linenumber") + 1).alias("dst"))
    seeds = l.where("l_linenumber = 1").select("func", F.col("l_linenumber").alias("value"))
    return ir.tainted(moves, seeds, lambda df: written(df, "taint")).groupBy("func").agg(F.count(F.lit(1)).alias("n"))


#: Blocks of a function: each goes to the next one, every fifth goes back by three, every fourth jumps two ahead.
_FLOW_SQL = """f AS (SELECT user_id, (count(*) + 9) // 10 AS n FROM events GROUP BY 1), b AS (SELECT user_id, n, unnest(generate_series(0, n - 1)) AS x FROM f),
e AS (SELECT user_id, x AS src, x + 1 AS dst FROM b WHERE x + 1 < n UNION SELECT user_id, x, x - 3 FROM b WHERE x % 5 = 4 UNION SELECT user_id, x, x + 2 FROM b WHERE x % 4 = 0 AND x + 2 < n)"""


def flow(spark: SparkSession, d: str) -> DataFrame:
    n = B.table(spark, d, "events").groupBy("user_id").agg(F.expr("(count(*) + 9) div 10").alias("n"))
    b = n.select("user_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("src"))
    e = lambda on, step: b.where(on).select("user_id", "src", (F.col("src") + step).alias("dst"))
    return e("src + 1 < n", 1).unionByName(e("src % 5 = 4", -3)).unionByName(e("src % 4 = 0 AND src + 2 < n", 2)).distinct()


@query(f"""WITH RECURSIVE {_FLOW_SQL}, back AS (SELECT user_id, dst AS header, src AS tail FROM e WHERE dst <= src), w AS (SELECT user_id, header, tail AS x FROM back UNION SELECT w.user_id, header, src FROM w JOIN e ON e.user_id = w.user_id AND e.dst = w.x WHERE w.x <> header), body AS (SELECT DISTINCT user_id, header, x FROM w UNION SELECT user_id, header, header FROM back),
x AS (SELECT DISTINCT p.user_id, p.header, e.dst FROM body p JOIN e ON e.user_id = p.user_id AND e.src = p.x LEFT JOIN body q ON q.user_id = p.user_id AND q.header = p.header AND q.x = e.dst WHERE q.x IS NULL)
SELECT user_id, header, string_agg(x, ',' ORDER BY x) AS body, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM x WHERE x.user_id = b.user_id AND x.header = b.header), '') AS exits FROM body b GROUP BY user_id, header""")
def td_ir_loops(spark: SparkSession, d: str) -> DataFrame:
    """Bodies and exits of the natural loops of each function's flow."""
    l = graph.loops(flow(spark, d), ["user_id"], lambda df: written(df, "loops"))
    return l.select("user_id", "header", F.array_join("body", ",").alias("body"), F.array_join("exits", ",").alias("exits"))
