"""Queries of the operators on operands and flows: a user of the table events is a function, an event an instruction, whose
operands are earlier instructions, parameters or constants; ten instructions are a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import defuse, ir, reentrancy
from . import bindings as B
from . import instructions as I

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CLICKS = ("Require", "Eq", "MsgSender", "Cast", "Add", "Mul", "TxOrigin", "Ne")
OTHERS = ("Cast", "Sub", "Mul", "Require", "And")
MESSAGES = ("owner only", "call failed", "deadline passed", "")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def instr(spark: SparkSession, d: str) -> DataFrame:
    e, u, k, kind = B.table(spark, d, "events"), F.col("user_id"), F.col("event_id"), F.col("event_type")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    op = F.when(kind == "error", F.when((k % 3 == 2) & (k % 2 == 0), "DelegateCall").otherwise("Call")).when(kind == "purchase", B.chosen(reentrancy.STORES, k)).when(kind == "view", B.chosen(defuse.LOADS, k)).when(kind == "click", B.chosen(CLICKS, k)).otherwise(B.chosen(OTHERS, k))
    inside = (kind == "error") & (k % 3 == 0)
    other = u + 5 * (1 + k % 7)
    name = F.when(inside, F.concat(B.chosen(I.NAMES, other), other.cast("string"))).when(kind == "error", B.chosen(I.CALLED, k))
    out = e.select(F.concat(F.lit("K"), F.pmod(u, F.lit(5)), F.lit("_"), F.expr("user_id div 100")).alias("contract"), F.concat(B.chosen(I.NAMES, u), u.cast("string")).alias("func"), idx.alias("idx"), op.alias("op"), name.alias("name"), F.when(kind == "error", F.when(inside, "Internal").otherwise("External")).alias("target"), k.alias("event_id"), kind.alias("kind"))
    value = F.when(~F.col("op").isin("Require", *reentrancy.STORES), F.concat(F.lit("v"), "idx"))
    first = F.concat(F.lit("v"), F.col("idx") - 1 - F.when(F.col("event_id") % 4 == 0, 1).otherwise(0))
    second = F.when(F.col("event_id") % 4 == 0, "const:1").when(F.col("event_id") % 8 == 1, "param:0").otherwise(F.concat(F.lit("v"), F.col("idx") - 1 - F.col("event_id") % 5))
    operands = F.when(F.col("event_id") % 16 == 4, F.array(F.lit("const:2"), F.lit("const:1"))).otherwise(F.array(first, second))
    key = F.when(F.col("kind").isin("purchase", "view"), F.concat(F.lit("slot"), F.col("event_id") % 5))
    return out.select("contract", "func", F.expr("idx div 10").alias("block"), "idx", F.col("idx").alias("pos"), "op", key.alias("key"), "name", F.when(F.col("op") == "Require", B.chosen(MESSAGES, F.expr("event_id div 8"))).alias("message"), "target", value.alias("value"), operands.alias("operands"))


def functions(spark: SparkSession, d: str) -> DataFrame:
    """As the other queries' functions, in contracts of twenty."""
    user = F.regexp_extract("func", r"(\d+)$", 1).cast("long")
    return I.functions(spark, d).withColumn("u", user).withColumn("contract", F.concat("contract", F.lit("_"), F.expr("u div 100"))).drop("u")


def successors(spark: SparkSession, d: str) -> DataFrame:
    """Blocks after each block: the next one, by every fourth one that two ahead, by every fifth one that three back."""
    n = instr(spark, d).groupBy("contract", "func").agg((F.max("block") + 1).alias("n"))
    b = n.select("contract", "func", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    to = F.array(F.when(F.col("block") + 1 < F.col("n"), F.col("block") + 1), F.when((F.col("block") % 4 == 0) & (F.col("block") + 2 < F.col("n")), F.col("block") + 2), F.when(F.col("block") % 5 == 4, F.col("block") - 3))
    return b.select("contract", "func", "block", F.filter(to, lambda x: x.isNotNull()).alias("next"))


SQL = f"""raw AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 'K' || user_id % 5 || '_' || user_id // 100 AS contract, {B.sql_chosen(I.NAMES, 'user_id')} || user_id AS func, event_type = 'error' AS err, event_id % 3 = 0 AS inside FROM events),
o AS (SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 6 = 2 THEN 'DelegateCall' ELSE 'Call' END WHEN 'purchase' THEN {B.sql_chosen(reentrancy.STORES, 'event_id')} WHEN 'view' THEN {B.sql_chosen(defuse.LOADS, 'event_id')} WHEN 'click' THEN {B.sql_chosen(CLICKS, 'event_id')} ELSE {B.sql_chosen(OTHERS, 'event_id')} END AS op FROM raw),
i AS (SELECT contract, func, idx // 10 AS block, idx AS pos, op, CASE WHEN event_type IN ('purchase', 'view') THEN 'slot' || event_id % 5 END AS key,
  CASE WHEN err AND inside THEN {B.sql_chosen(I.NAMES, 'user_id + 5 * (1 + event_id % 7)')} || (user_id + 5 * (1 + event_id % 7)) WHEN err THEN {B.sql_chosen(I.CALLED, 'event_id')} END AS name,
  CASE WHEN op = 'Require' THEN {B.sql_chosen(MESSAGES, 'event_id // 8')} END AS message, CASE WHEN op NOT IN ('Require', 'StorageStore', 'MappingStore', 'ArrayStore') THEN 'v' || idx END AS value,
  CASE WHEN event_id % 16 = 4 THEN 'const:2' ELSE 'v' || (idx - 1 - CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) END AS a,
  CASE WHEN event_id % 4 = 0 THEN 'const:1' WHEN event_id % 8 = 1 THEN 'param:0' ELSE 'v' || (idx - 1 - event_id % 5) END AS b, err AND NOT inside AS ext, op = 'Call' AND err AND NOT inside AS xcall, op LIKE '%Store' AS w FROM o),
fn AS (SELECT DISTINCT 'K' || user_id % 5 || '_' || user_id // 100 AS contract, {B.sql_chosen(I.NAMES, 'user_id')} || user_id AS func, {B.sql_chosen(B.VISIBILITY, 'user_id')} AS visibility, CASE user_id % 7 WHEN 0 THEN 'onlyOwner' WHEN 1 THEN 'nonReentrant' ELSE '' END AS modifier FROM events),
u AS (SELECT func, pos, op, value, unnest([a, b]) AS x FROM i)"""
FLOW = """n AS (SELECT contract, func, max(block) + 1 AS n FROM i GROUP BY ALL), blk AS (SELECT contract, func, n, unnest(range(n)) AS block FROM n),
s AS (SELECT contract, func, block, list_filter([CASE WHEN block + 1 < n THEN block + 1 END, CASE WHEN block % 4 = 0 AND block + 2 < n THEN block + 2 END, CASE WHEN block % 5 = 4 THEN block - 3 END], lambda x: x IS NOT NULL) AS nx FROM blk)"""
SENDERS = "sender AS (SELECT func, value FROM i WHERE op = 'MsgSender' UNION SELECT u.func, u.value FROM sender JOIN u ON u.func = sender.func AND u.x = sender.value AND u.op = 'Cast')"


@query(f"WITH RECURSIVE {SQL}, {SENDERS} SELECT i.contract, func, value FROM sender JOIN i USING (func, value)")
def td_flow_senders(spark: SparkSession, d: str) -> DataFrame:
    """Values that are the caller."""
    return defuse.senders(instr(spark, d))


@query(f"""WITH RECURSIVE {SQL}, p AS (SELECT func, pos, value, a, b FROM i WHERE op IN ('Cast', 'Add', 'Sub', 'Mul', 'And', 'Eq', 'Ne')),
c AS (SELECT func, list({{'p': pos, 'v': value, 'a': a, 'b': b}} ORDER BY pos) AS l FROM p GROUP BY func),
k AS (SELECT func, list_reduce(list_prepend([]::VARCHAR[], list_transform(l, lambda r: [r.v, r.a, r.b])), lambda seen, r: CASE WHEN (r[2] LIKE 'const:%' OR list_contains(seen, r[2])) AND (r[3] LIKE 'const:%' OR list_contains(seen, r[3])) THEN list_append(seen, r[1]) ELSE seen END) AS vs FROM c)
SELECT DISTINCT i.contract, k.func, v AS value FROM (SELECT func, unnest(vs) AS v FROM k) k JOIN i ON i.func = k.func AND i.value = v""")
def td_flow_constants(spark: SparkSession, d: str) -> DataFrame:
    """Values that are made of constants alone (operands come before their uses here, so that SQL can go through once)."""
    return defuse.constants(instr(spark, d))


@query(f"""WITH RECURSIVE {SQL}, {SENDERS},
k AS (SELECT i.*, s.value IS NOT NULL AS own FROM i LEFT JOIN sender s ON s.func = i.func AND s.value = i.a),
g AS (SELECT contract, func, lower(func) AS low, count(*) FILTER (m) AS mods, min(pos) FILTER (m) AS pos, bool_or(op = 'StorageStore') AS st, bool_or(xcall) AS lv, bool_or(op = 'Require' OR (op = 'MappingLoad' AND own)) AS req FROM (SELECT *, op = 'StorageStore' OR xcall OR (op IN ('MappingStore', 'ArrayStore') AND NOT own) AS m FROM k) GROUP BY ALL),
f AS (SELECT g.*, regexp_matches(low, '{ir.CRITICAL}') AS cn, regexp_matches(low, '{ir.SELF_SERVICE}') AS slf, req OR EXISTS (SELECT 1 FROM u JOIN sender ON sender.func = u.func AND sender.value = x WHERE u.func = g.func AND u.op = 'Eq') AS checked FROM g JOIN fn USING (func) WHERE visibility IN ('public', 'external') AND modifier = '' AND mods > 0)
SELECT contract, func, pos, 'missing-access-control' AS finding_type, CASE WHEN slf THEN 'Low' WHEN lv OR (cn AND st) THEN 'High' WHEN cn OR mods > 2 THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN slf THEN 'Low' WHEN mods > 1 THEN 'High' ELSE 'Medium' END AS confidence
FROM f WHERE NOT checked AND NOT (NOT lv AND NOT st AND NOT regexp_matches(low, '{ir.PERMISSION}') AND (regexp_matches(low, '{ir.TRIVIAL}') OR (mods = 1 AND low NOT LIKE '%set%')))
UNION ALL SELECT f.contract, f.func, i.pos, 'weak-access-control-tx-origin', 'Medium', 'High' FROM f JOIN i USING (func) WHERE checked AND op = 'TxOrigin'""")
def td_ir_access_control(spark: SparkSession, d: str) -> DataFrame:
    return defuse.access_control(instr(spark, d), functions(spark, d))


@query(f"""WITH {SQL} SELECT contract, func, pos, name FROM i c WHERE op = 'Call' AND (xcall OR name LIKE '%call%')
AND NOT EXISTS (SELECT 1 FROM i r WHERE r.func = c.func AND r.block = c.block AND r.op = 'Require' AND r.pos > c.pos AND NOT EXISTS (SELECT 1 FROM i x WHERE x.func = c.func AND x.block = c.block AND x.xcall AND x.pos > c.pos AND x.pos < r.pos)
  AND (regexp_matches(r.message, 'failed|success|transfer|call') OR r.a = c.value OR EXISTS (SELECT 1 FROM u WHERE u.func = c.func AND u.op IN ('Eq', 'Ne', 'And') AND u.value = r.a AND u.x = c.value)))
AND NOT EXISTS (SELECT 1 FROM u WHERE u.func = c.func AND u.op IN ('Eq', 'Ne') AND u.x = c.value)""")
def td_flow_unchecked_returns(spark: SparkSession, d: str) -> DataFrame:
    return defuse.unchecked_returns(instr(spark, d))


@query(f"""WITH {SQL}, {FLOW}, e AS (SELECT func, block, unnest(nx) AS dst FROM s), l AS (SELECT func, block FROM e WHERE dst <= block UNION SELECT func, dst FROM e WHERE dst <= block),
src AS (SELECT func, value FROM i WHERE op IN ('MsgSender', 'TxOrigin', 'StorageLoad', 'MappingLoad') OR xcall)
SELECT i.contract, i.func, i.pos, i.op, CASE WHEN i.op = 'Sub' OR (i.op = 'Mul' AND l.func IS NOT NULL) THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN l.func IS NOT NULL THEN 'High' ELSE 'Medium' END AS confidence
FROM i LEFT JOIN l ON l.func = i.func AND l.block = i.block WHERE op IN ('Add', 'Sub', 'Mul') AND (a LIKE 'param:%' OR b LIKE 'param:%' OR EXISTS (SELECT 1 FROM src WHERE src.func = i.func AND src.value IN (a, b)))""")
def td_flow_overflows(spark: SparkSession, d: str) -> DataFrame:
    back = successors(spark, d).select("contract", "func", "block", F.explode("next").alias("to")).where("to <= block")
    return defuse.overflows(instr(spark, d), back.select("contract", "func", F.explode(F.array("block", "to")).alias("block")))


EDGES = "e AS (SELECT DISTINCT i.contract, i.func AS src, i.name AS dst, pos FROM i JOIN fn ON fn.contract = i.contract AND fn.func = i.name WHERE i.op = 'Call' AND NOT ext)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    inner = instr(spark, d).where("target = 'Internal'")
    return ir.call_edges(inner, functions(spark, d))


#: Breadth first, as UNION ALL adds a round at a time and each keeps what no round before had.
CLOSED = """t(contract, start, node, path, depth) USING KEY (contract, start, node) AS (SELECT DISTINCT contract, src, src, src, 0 FROM e
  UNION SELECT contract, start, node, min(path), any_value(depth) FROM (SELECT t.contract, t.start, e.dst AS node, t.path || '>' || e.dst AS path, t.depth + 1 AS depth FROM t JOIN e ON e.contract = t.contract AND e.src = t.node) z
  WHERE NOT EXISTS (SELECT 1 FROM recurring.t o WHERE o.contract = z.contract AND o.start = z.start AND o.node = z.node) GROUP BY contract, start, node)"""
CROSS = """x AS (SELECT t.contract, t.start AS func, t.node AS other, t.path, keys, first FROM t JOIN (SELECT func, min(pos) AS first FROM i WHERE ext OR op = 'DelegateCall' GROUP BY ALL) f ON f.func = t.start
  JOIN (SELECT func, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM i WHERE w GROUP BY ALL) y ON y.func = t.node LEFT JOIN (SELECT src, dst, max(pos) AS called FROM e GROUP BY ALL) c ON c.src = t.start AND c.dst = t.node WHERE t.depth > 0 AND (called IS NULL OR called > first))"""
#: Rounds of the search: each path has its number n in the order taken up; base: how many the function's earlier rounds took up.
PATHS = f"""q AS (SELECT contract, func, [min(block)] AS path, CAST(1 AS BIGINT) AS n, 1 AS len FROM s GROUP BY ALL
  UNION ALL SELECT contract, func, list_append(path, to_), top + row_number() OVER (PARTITION BY func ORDER BY n, turn) AS n, len + 1
  FROM (SELECT q.*, max(q.n) OVER (PARTITION BY q.func) AS top, unnest(s.nx) AS to_, generate_subscripts(s.nx, 1) AS turn FROM q JOIN s ON s.func = q.func AND s.block = q.path[-1] WHERE q.n <= {reentrancy.MOST}) z
  WHERE len < {reentrancy.LONGEST} AND (len < {reentrancy.AGAIN} OR NOT list_contains(path, to_))),
d AS (SELECT contract, func, n, 0 AS turn, path FROM q JOIN s USING (contract, func) WHERE s.block = q.path[-1] AND len(nx) = 0 AND n <= {reentrancy.MOST}
  UNION ALL SELECT contract, func, n, turn, path FROM (SELECT q.*, unnest(s.nx) AS to_, generate_subscripts(s.nx, 1) AS turn FROM q JOIN s USING (contract, func) WHERE s.block = q.path[-1] AND len = {reentrancy.LONGEST} AND n <= {reentrancy.MOST}) WHERE NOT list_contains(path, to_)),
p AS (SELECT contract, func, row_number() OVER (PARTITION BY func ORDER BY n, turn) AS n, path FROM d)"""
BRANCHED = """h AS (SELECT func, block, min_by(path, n) AS path FROM (SELECT func, n, path, unnest(path) AS block FROM p) GROUP BY ALL),
cond AS (SELECT c.contract, c.func, c.pos AS call, m.pos AS write, a.path AS pa, b.path AS pb, list_position(list_transform(range(1, least(len(a.path), len(b.path)) + 1), lambda k: a.path[k] = b.path[k]), false) AS differ
  FROM i c JOIN h a ON a.func = c.func AND a.block = c.block JOIN i m ON m.func = c.func JOIN h b ON b.func = m.func AND b.block = m.block WHERE (c.ext OR c.op = 'DelegateCall') AND m.w)"""


@query(f"WITH RECURSIVE {SQL}, {EDGES}, {CLOSED} SELECT contract, start, node, CAST(depth AS BIGINT) AS depth, path FROM t")
def td_flow_call_closure(spark: SparkSession, d: str) -> DataFrame:
    """Functions that each function reaches by calls, with a shortest path."""
    e = edges(spark, d).where("NOT is_external").select("contract", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return reentrancy.closure(e, ["contract"]).withColumn("path", F.array_join("path", ">"))


@query(f"WITH RECURSIVE {SQL}, {EDGES}, {CLOSED}, {CROSS} SELECT contract, func, other, path, keys, false AS is_hook FROM x")
def td_ir_cross_function(spark: SparkSession, d: str) -> DataFrame:
    x = reentrancy.cross_function(instr(spark, d), edges(spark, d))
    return x.withColumns({"path": F.array_join("path", ">"), "keys": F.array_join("keys", ",")})


@query(f"WITH RECURSIVE {SQL}, {FLOW}, {PATHS} SELECT contract, func, n, array_to_string(path, ',') AS path FROM p")
def td_flow_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths through each function's blocks, breadth first."""
    return reentrancy.explored(successors(spark, d), ir.BY).withColumn("path", F.array_join("path", ","))


@query(f"WITH RECURSIVE {SQL}, {FLOW}, {PATHS}, {BRANCHED} SELECT contract, func, call, write, CASE WHEN differ > 1 THEN pa[differ - 1] WHEN coalesce(differ, 0) = 0 AND len(pa) <> len(pb) THEN pa[least(len(pa), len(pb))] END AS parts_at FROM cond")
def td_flow_conditional_reentrancy(spark: SparkSession, d: str) -> DataFrame:
    return reentrancy.conditional(reentrancy.explored(successors(spark, d), ir.BY), instr(spark, d))


@query(f"""WITH RECURSIVE {SQL.replace('i AS (', 'every AS (', 1).replace('FROM i)', 'FROM every)')}, all_i AS (SELECT * FROM every),
safe AS (SELECT func FROM (SELECT func, min(pos) FILTER (op IN ('Call', 'DelegateCall')) AS c1, min(pos) FILTER (w) AS w1, coalesce(bool_or(name = 'safeTransferFrom'), false) AS st FROM every GROUP BY func) JOIN fn USING (func) WHERE modifier = 'nonReentrant' AND (coalesce(w1 < c1, false) OR st)),
{EDGES.replace('FROM i ', 'FROM every i ')}, {CLOSED}, {CROSS.replace('FROM i ', 'FROM every ')}, i AS (SELECT * FROM every WHERE func NOT IN (SELECT func FROM safe)), {FLOW}, {PATHS}, {BRANCHED},
c AS (SELECT contract, func, block, pos FROM i WHERE ext OR op = 'DelegateCall'), g AS (SELECT func, block AS src, unnest(nx) AS dst FROM s),
lp(func, header, b) AS (SELECT func, dst, src FROM g WHERE dst <= src UNION SELECT lp.func, header, src FROM lp JOIN g ON g.func = lp.func AND g.dst = lp.b WHERE lp.b <> header),
body AS (SELECT * FROM lp UNION SELECT func, header, header FROM lp), ex AS (SELECT DISTINCT body.func, header, dst FROM body JOIN g ON g.func = body.func AND g.src = b WHERE NOT EXISTS (SELECT 1 FROM body o WHERE o.func = g.func AND o.header = body.header AND o.b = dst)),
near(func, header, b, k) AS (SELECT func, header, dst, 0 FROM ex UNION SELECT near.func, header, dst, k + 1 FROM near JOIN g ON g.func = near.func AND g.src = near.b WHERE k < 10)
SELECT c.contract, c.func, 'reentrancy' AS finding_type, c.pos AS at, CAST(m.pos AS VARCHAR) AS what FROM c JOIN i m ON m.func = c.func AND m.w AND ((m.block = c.block AND m.pos > c.pos) OR m.block > c.block)
UNION ALL SELECT contract, func, 'cross-function-reentrancy', first, other FROM x WHERE func NOT IN (SELECT func FROM safe)
UNION ALL SELECT contract, func, 'conditional-reentrancy', call, CAST(write AS VARCHAR) FROM cond
UNION ALL SELECT c.contract, c.func, 'reentrancy-pattern', c.pos, CAST(min(m.pos) AS VARCHAR) FROM c JOIN i m ON m.func = c.func AND m.w AND m.pos > c.pos GROUP BY ALL
UNION ALL SELECT z.contract, z.func, 'loop-reentrancy', z.at, CAST(y.b AS VARCHAR) FROM (SELECT c.contract, c.func, header, min(c.pos) AS at FROM body JOIN c ON c.func = body.func AND c.block = b GROUP BY ALL) z JOIN (SELECT near.func, header, min(near.b) AS b FROM near JOIN i ON i.func = near.func AND i.block = near.b AND i.w GROUP BY ALL) y ON y.func = z.func AND y.header = z.header""")
def td_flow_reentrancy(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of reentrancy of functions that no guard protects."""
    return reentrancy.reentrancy(instr(spark, d), functions(spark, d), edges(spark, d), successors(spark, d))


LOOPS = """g AS (SELECT func, block AS src, unnest(nx) AS dst FROM s), lp(func, header, b) AS (SELECT func, dst, src FROM g WHERE dst <= src UNION SELECT lp.func, header, src FROM lp JOIN g ON g.func = lp.func AND g.dst = lp.b WHERE lp.b <> header),
body AS (SELECT * FROM lp UNION SELECT func, header, header FROM lp), ex AS (SELECT DISTINCT body.func, header, dst FROM body JOIN g ON g.func = body.func AND g.src = b WHERE NOT EXISTS (SELECT 1 FROM body o WHERE o.func = g.func AND o.header = body.header AND o.b = dst)),
near(func, header, b, k) AS (SELECT func, header, dst, 0 FROM ex UNION SELECT near.func, header, dst, k + 1 FROM near JOIN g ON g.func = near.func AND g.src = near.b WHERE k < 10)"""


@query(f"""WITH RECURSIVE {SQL}, {FLOW}, {LOOPS} SELECT c.contract, c.func, c.header, calls, writes FROM (SELECT i.contract, i.func, header, string_agg(pos, ',' ORDER BY pos) AS calls FROM body JOIN i ON i.func = body.func AND i.block = body.b WHERE ext OR op = 'DelegateCall' GROUP BY ALL) c
JOIN (SELECT func, header, string_agg(x, ',' ORDER BY x) AS writes FROM (SELECT DISTINCT near.func, header, near.b AS x FROM near JOIN i ON i.func = near.func AND i.block = near.b WHERE w) GROUP BY ALL) y ON y.func = c.func AND y.header = c.header""")
def td_flow_loop_reentrancy(spark: SparkSession, d: str) -> DataFrame:
    """Loops with calls outside, and the blocks after them that write state."""
    blocks = successors(spark, d).select("contract", "func", F.col("block").alias("src"), F.explode("next").alias("dst"))
    found = reentrancy.in_loops(instr(spark, d), blocks)
    return found.withColumns({c: F.array_join(c, ",") for c in ("calls", "writes")})


@query(f"WITH {SQL} SELECT contract, func, pos, slot, operand FROM (SELECT contract, func, pos, 0 AS slot, a AS operand FROM i UNION ALL SELECT contract, func, pos, 1, b FROM i)")
def td_flow_uses(spark: SparkSession, d: str) -> DataFrame:
    """Every operand of every instruction."""
    return defuse.uses(instr(spark, d)).select("contract", "func", "pos", "slot", "operand")


@query(f"""WITH {SQL} SELECT contract, func, 'reentrancy' AS focus, 'call' AS kind, block, pos, concat_ws(' ', op, name) AS text FROM i WHERE ext OR op = 'DelegateCall'
UNION ALL SELECT contract, func, 'reentrancy', 'write', block, pos, op || ' ' || key FROM i WHERE w UNION ALL SELECT contract, func, 'access', 'check', block, pos, 'require(' || a || '): ' || message FROM i WHERE op = 'Require'
UNION ALL SELECT contract, func, 'access', 'sensitive', block, pos, 'Storage modification' FROM i WHERE op = 'StorageStore' UNION ALL SELECT contract, func, 'access', 'sensitive', block, pos, 'Value transfer to ' || name FROM i WHERE op = 'Call' AND name IN ('send', 'transfer', 'call')
UNION ALL SELECT contract, func, 'arithmetic', 'plain', block, pos, lower(op) || '(' || a || ', ' || b || ')' FROM i WHERE op IN ('Add', 'Sub', 'Mul')
UNION ALL SELECT contract, func, 'returns', CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.func = i.func AND u.x = i.value) THEN 'used' ELSE 'unused' END, block, pos, name FROM i WHERE xcall""")
def td_flow_focus(spark: SparkSession, d: str) -> DataFrame:
    """What each focus of an analysis looks at."""
    return defuse.found_in_focus(instr(spark, d))
