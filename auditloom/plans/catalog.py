"""All registered queries of the library proper, and their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import correlate, detectors, findings, graph, ir, prompts, render, sequence, source_text
from ..operators.facts import Facts
from ..sources import tree
from ..sources.tables import shared_folder
from . import bindings as B
from . import contracts as C
from . import flows
from . import instructions
from . import scan

FLAGSHIP = "td_findings_dedup"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


RANK = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


@query(f"""WITH {B.FINDINGS_SQL}, k AS (SELECT *, {B.CATEGORY_SQL} AS category, replace(file, 'contracts/', '') AS at_file, line // 5 AS bucket, {B.PRIORITY_SQL} AS priority FROM findings),
r AS (SELECT *, row_number() OVER (PARTITION BY category, at_file, bucket ORDER BY score DESC, priority, ord DESC) AS n FROM k) SELECT category, at_file, CAST(bucket AS BIGINT) AS bucket, ord, scanner_id, severity, confidence, score, file, line, function, priority FROM r WHERE n = 1""")
def td_findings_dedup(spark: SparkSession, d: str) -> DataFrame:
    return findings.deduplicated(B.findings(spark, d))


@query(f"""WITH {B.FINDINGS_SQL}, k AS (SELECT count(*) AS a, count(DISTINCT ({B.CATEGORY_SQL}, file, line // 5)) AS b FROM findings) SELECT a AS original, b AS deduplicated, a - b AS removed, CASE WHEN a > 0 THEN round(100.0 * (a - b) / a, 4) ELSE 0 END AS reduction FROM k""")
def td_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return findings.dedup_stats(B.findings(spark, d))


@query(f"""WITH {B.FINDINGS_SQL} SELECT scanner_id, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low, count(*) FILTER (severity = 'Informational') AS informational, count(*) AS total FROM findings GROUP BY scanner_id""")
def td_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.severity_counts(B.findings(spark, d), "scanner_id")


@query(f"""WITH {B.FINDINGS_SQL} SELECT ord, severity, score FROM findings WHERE {RANK} >= 3 AND score >= 0.6""")
def td_min_severity_confidence(spark: SparkSession, d: str) -> DataFrame:
    return findings.at_least(B.findings(spark, d), "High", 0.6).select("ord", "severity", "score")


@query(f"""WITH {B.FINDINGS_SQL} SELECT ord, {B.PRIORITY_SQL} AS priority FROM findings QUALIFY row_number() OVER (PARTITION BY file ORDER BY {B.PRIORITY_SQL} DESC, ord) <= 5""")
def td_top_per_file(spark: SparkSession, d: str) -> DataFrame:
    """The five findings of the highest priority of each file (a top-k report)."""
    f = B.findings(spark, d).withColumn("priority", rules.priority(F.col("severity"), F.col("confidence")))
    return f.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("priority"), "ord"))).where("n <= 5").select("ord", "priority")


@query(f"""WITH {B.FINDINGS_SQL} SELECT ord, function FROM findings WHERE NOT (score < 0.3 OR lower(function) LIKE 'get%' OR lower(function) LIKE 'has%' OR lower(function) LIKE 'can%' OR lower(function) LIKE 'check%' OR (lower(function) LIKE 'is%' AND (scanner_id <> 'simple-timestamp' OR {RANK} < 3)) OR (severity = 'Informational' AND confidence = 'Low'))""")
def td_suppression(spark: SparkSession, d: str) -> DataFrame:
    f = B.findings(spark, d)
    return f.where(~rules.suppressed(F.col("score"), F.col("function"), F.col("scanner_id"), F.col("severity"), F.col("confidence"))).select("ord", "function")


@query("""WITH c AS (SELECT p_partkey, (['Token', 'MockToken', 'SafeVault', 'Vault', 'PoolExample', 'TestPool'])[CAST(p_partkey % 6 AS INT) + 1] || p_size AS a, (['Vault', 'VaultExample'])[CAST(p_partkey % 2 AS INT) + 1] AS b FROM part) SELECT p_partkey, regexp_matches(a, '^(Attack|Exploit|Test|Mock|Secure|Fixed|Safe|Example)|Example$') AS by_start, regexp_matches(b, '^(Attack|Exploit|Test|Mock|Secure|Fixed|Safe|Example)|Example$') AS by_end FROM c""")
def td_skip_contracts(spark: SparkSession, d: str) -> DataFrame:
    p = B.table(spark, d, "part")
    a = F.concat(B.chosen(("Token", "MockToken", "SafeVault", "Vault", "PoolExample", "TestPool"), F.col("p_partkey")), F.col("p_size"))
    return p.select("p_partkey", rules.skipped_contract(a).alias("by_start"), rules.skipped_contract(B.chosen(("Vault", "VaultExample"), F.col("p_partkey"))).alias("by_end"))


@query("""WITH o AS (SELECT *, CAST(left(o_orderpriority, 1) AS INT) AS p, o_orderkey % 3 AS v, o_orderkey % 5 AS s, o_orderkey % 7 AS t FROM orders),
a AS (SELECT *, least(5 - p + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END, 4) AS r FROM o), b AS (SELECT *, least(r + CASE WHEN v < 2 THEN 1 ELSE 0 END, 4) AS r2 FROM a),
c AS (SELECT *, CASE WHEN s = 0 AND t IN (0, 1) THEN 4 ELSE r2 END AS r3 FROM b) SELECT o_orderkey, (['Informational', 'Low', 'Medium', 'High', 'Critical'])[CASE WHEN t = 2 THEN greatest(r3 - 1, 0) ELSE r3 END + 1] AS severity FROM c""")
def td_severity_rules(spark: SparkSession, d: str) -> DataFrame:
    o, k = B.table(spark, d, "orders"), F.col("o_orderkey")
    base = rules.severity_name(5 - F.substring("o_orderpriority", 1, 1).cast("int"))
    contract = F.when(F.col("o_orderstatus") == "O", "TokenA").otherwise("PoolA")
    scanner = F.when(k % 5 == 0, "reentrancy-simple").otherwise("other")
    about = B.chosen(("a withdraw path", "a transfer path", "unused", "plain", "plain", "plain", "plain"), k)
    return o.select("o_orderkey", rules.adjusted_severity(base, contract, B.chosen(B.VISIBILITY, k), scanner, about).alias("severity"))


@query("""WITH p AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM events) SELECT a.user_id AS file, count(*) AS pairs, round(sum(1 - abs(a.m - b.m) / 10.0), 4) AS score FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.m - b.m) < 10 GROUP BY 1""")
def td_location_correlation(spark: SparkSession, d: str) -> DataFrame:
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    e = B.table(spark, d, "events").select("event_id", "user_id", minute.alias("m"))
    return correlate.near_pairs(e, "user_id", "m", "event_id").groupBy("file").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("score"), 4).alias("score"))


_WORDS = r"list_distinct(list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: strlen(w) > 3), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')))"


@query(f"""WITH t AS (SELECT p_partkey, p_brand || p_size AS g, p_name || ' ' || p_type AS text FROM part), w AS (SELECT p_partkey, g, {_WORDS} AS w FROM t),
s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(list_concat(a.w, b.w))) AS u FROM w a JOIN w b ON a.g = b.g AND a.p_partkey < b.p_partkey) SELECT a, b, round(0.7 * i / u, 6) AS score FROM s WHERE i > 0 AND i / u >= 0.3""")
def td_semantic_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and size as the findings of one file, their names as descriptions."""
    p = B.table(spark, d, "part").select("p_partkey", F.concat("p_brand", "p_size").alias("g"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return correlate.semantic(p, "g", "p_partkey", "text").drop("g")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, avg(l_discount * 10) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, n, round(m, 6) AS mean, round(least(m * ln(n) / 10, 0.3), 6) AS boost, least(m * ln(n) / 10, 0.3) > 0.2 AS raised FROM g""")
def td_confidence_boost(spark: SparkSession, d: str) -> DataFrame:
    return correlate.boosted(B.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("s")), "l_orderkey", "s")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag = 'N') = 2""")
def td_cross_validated(spark: SparkSession, d: str) -> DataFrame:
    return correlate.cross_validated(B.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "N").alias("llm")), "l_orderkey", "llm")


@query("""SELECT l_orderkey, arg_max(l_linenumber, (l_discount, -l_linenumber)) AS l_linenumber, round(least(max(l_discount) + 0.2 * avg(l_discount), 1), 6) AS l_discount, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS l_suppkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS l_returnflag FROM lineitem GROUP BY 1""")
def td_merged_groups(spark: SparkSession, d: str) -> DataFrame:
    l = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_suppkey", "l_returnflag")
    return correlate.merged(l, "l_orderkey", "l_linenumber", "l_discount", "l_suppkey", "l_returnflag")


BY, ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")


@query("""SELECT w.user_id, count(*) AS pairs, count(DISTINCT w.event_id) AS writes_after_call FROM events w JOIN events c ON c.user_id = w.user_id AND c.event_type = 'error' AND (c.ts, c.event_id) < (w.ts, w.event_id) WHERE w.event_type = 'purchase' GROUP BY 1""")
def td_call_then_write(spark: SparkSession, d: str) -> DataFrame:
    return sequence.call_write_pairs(_events(spark, d), BY, ORDER, F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""SELECT c.event_id, (SELECT arg_min(w.event_id, (w.ts, w.event_id)) FROM events w WHERE w.user_id = c.user_id AND w.event_type = 'purchase' AND (w.ts, w.event_id) > (c.ts, c.event_id)) AS first_write FROM events c WHERE c.event_type = 'error' AND EXISTS (SELECT 1 FROM events w WHERE w.user_id = c.user_id AND w.event_type = 'purchase' AND (w.ts, w.event_id) > (c.ts, c.event_id))""")
def td_first_write_after_call(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return sequence.first_after(e, BY, ORDER, F.col("event_type") == "error", F.col("event_type") == "purchase", "event_id").select("event_id", "first_write")


@query("""WITH r AS (SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), g AS (SELECT user_id, run, count(*) FILTER (event_type = 'view') AS c FROM r WHERE run > 0 GROUP BY 1, 2) SELECT user_id, count(*) AS calls, count(*) FILTER (c = 0) AS unchecked FROM g GROUP BY 1""")
def td_unchecked_calls(spark: SparkSession, d: str) -> DataFrame:
    return sequence.unchecked_calls(_events(spark, d), BY, ORDER, F.col("event_type") == "click", F.col("event_type") == "view")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS ops, count(*) FILTER (l_returnflag = 'R') AS loops FROM lineitem GROUP BY 1) SELECT *, CASE WHEN ops > 5 THEN 'gas-limit-dos' ELSE 'moderate-gas-dos' END AS finding_type, CASE WHEN ops <= 5 THEN 'Low' WHEN ops > 10 OR loops > 2 THEN 'High' ELSE 'Medium' END AS severity FROM g WHERE ops > 3 AND loops > 0""")
def td_gas_thresholds(spark: SparkSession, d: str) -> DataFrame:
    g = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("ops"), F.count_if(F.col("l_returnflag") == "R").alias("loops"))
    return sequence.gas_findings(g, "ops", "loops")


@query("""WITH g AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'O') AS stores FROM lineitem GROUP BY 1) SELECT l_suppkey, stores FROM g WHERE stores > 10""")
def td_state_modifications(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("stores")).where("stores > 10")


@query("""WITH x AS (SELECT (['mul', 'sub', 'add', 'div'])[l_linenumber % 4 + 1] AS op, l_returnflag = 'R' AS external, l_linestatus = 'O' AS in_loop FROM lineitem),
y AS (SELECT *, CASE WHEN NOT external OR op = 'div' THEN NULL WHEN op = 'sub' OR (op = 'mul' AND in_loop) THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN NOT external OR op = 'div' THEN NULL WHEN in_loop THEN 'High' ELSE 'Medium' END AS confidence FROM x) SELECT op, in_loop, severity, confidence, count(*) AS n FROM y WHERE severity IS NOT NULL GROUP BY ALL""")
def td_overflow_matrix(spark: SparkSession, d: str) -> DataFrame:
    x = B.table(spark, d, "lineitem").select(B.chosen(("mul", "sub", "add", "div"), F.col("l_linenumber")).alias("op"), (F.col("l_returnflag") == "R").alias("external"), (F.col("l_linestatus") == "O").alias("in_loop"))
    severity, confidence = sequence.overflow_matrix(F.col("op"), F.col("external"), F.col("in_loop"))
    return x.select("op", "in_loop", severity.alias("severity"), confidence.alias("confidence")).where("severity is not null").groupBy("op", "in_loop", "severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


EDGES_SQL = """e AS (SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name, a, x, b, y: B.table(spark, d, name).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst")).distinct()
    return t("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(t("supplier", "n", "s_nationkey", "s", "s_suppkey")).unionByName(t("lineitem", "s", "l_suppkey", "p", "l_partkey"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT root, dst, depth + 1 FROM w JOIN e ON src = node), m AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS nodes FROM m GROUP BY ALL""")
def td_call_depths(spark: SparkSession, d: str) -> DataFrame:
    roots = B.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("root"))
    return graph.depths(_edges(spark, d), roots).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("""SELECT l_suppkey AS header, count(*) AS tails, max(l_partkey) AS last_tail FROM lineitem WHERE l_suppkey <= l_partkey GROUP BY 1""")
def td_back_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.back_edges(B.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS callees, count(*) AS paths, count(*) FILTER (l_returnflag = 'R') AS external_paths FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def td_function_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as callees and their lines as paths: pre-aggregated before the join."""
    l = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("x"))
    o = B.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("callees"), F.sum("p").alias("paths"), F.sum("x").alias("external_paths"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) SELECT doc_id, CAST(len(a) AS BIGINT) AS n_lines, md5(array_to_string(list_transform(a, lambda x, i: lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || x), chr(10))) AS numbered FROM l""")
def td_numbered_source(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.md5(source_text.numbered(F.col("text"))).alias("numbered"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), w AS (SELECT *, array_to_string(list(x) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), chr(10)) AS s FROM l) SELECT doc_id, line, md5(s) AS snippet FROM w WHERE regexp_matches(x, '(?i)licen[cs]e')""")
def td_context_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = B.table(spark, d, "documents")
    hits = docs.where(F.col("text").rlike("(?i)licen[cs]e"))  # lines of others have no part in a hit's context
    return source_text.context(source_text.lines(hits, "doc_id", "text"), "doc_id", F.col("line_text").rlike("(?i)licen[cs]e")).select("doc_id", "line", F.md5("snippet").alias("snippet"))


@query(r"""WITH h AS (SELECT page_id, '/* ' || url || chr(10) || ' */ a // b' || chr(10) || chr(9) || chr(10) || html || CASE WHEN page_id % 3 = 0 THEN '/* open' || chr(10) || 'end' ELSE '' END AS x FROM pages) SELECT page_id, md5(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(x, '/\*.*?(\*/|$)', '', 'gs'), '//[^\n]*', '', 'g'), chr(10)), lambda l: trim(translate(l, chr(9) || chr(13), '  ')) <> ''), chr(10))) AS stripped FROM h""")
def td_comment_strip(spark: SparkSession, d: str) -> DataFrame:
    """Pages with comments put before and, in a third of them, an open one behind."""
    x = F.concat(F.lit("/* "), "url", F.lit("\n */ a // b\n\t\n"), "html", F.when(F.col("page_id") % 3 == 0, F.lit("/* open\nend")).otherwise(F.lit("")))
    return B.table(spark, d, "pages").select("page_id", F.md5(source_text.stripped(x)).alias("stripped"))


@query("""WITH c AS (SELECT conv_id, turn, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM c) SELECT conv_id, turn, tokens, CAST(used AS BIGINT) AS used FROM r WHERE used <= 100""")
def td_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Turns that fit a budget of tokens, from the first on."""
    c = prompts.within_budget(B.table(spark, d, "conversations"), ["conv_id"], ["turn"], "text", 100)
    return c.select("conv_id", "turn", "tokens", "used")


@query("""SELECT event_type AS op, count(*) AS n, count(DISTINCT user_id) AS functions FROM events GROUP BY 1""")
def td_opcode_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ir.histogram(B.table(spark, d, "events").withColumnRenamed("event_type", "op"), of="user_id")


@query("""SELECT conv_id, turn, md5(replace(replace('Role: {role}. Find faults in: {source}', '{role}', role), '{source}', text)) AS prompt FROM conversations""")
def td_prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    prompt = prompts.filled("Role: {role}. Find faults in: {source}", role=F.col("role"), source=F.col("text"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.md5(prompt).alias("prompt"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def td_json_from_prose(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object within a text, in a fence or by its braces, parsed by a fixed schema."""
    inner = F.concat(F.lit('{"a": "}\\\\\\"{", "of": '), F.col("props"), F.lit("}"))
    prose = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), inner, F.lit("\n```\n{"))).otherwise(F.concat(F.lit("So: "), inner, F.lit(" and } or {")))
    return B.table(spark, d, "events").select("event_id", F.from_json(prompts.json_of(prose), "of struct<k: bigint>")["of"]["k"].alias("k"))


_T = {"x": B.sql_chosen(B.STATEMENTS, "event_id"), "f": B.sql_chosen(B.FUNCTION_NAMES, "user_id"), "m": B.sql_chosen(B.MUTABILITY, "event_id // 8")}


@query(f"""WITH t AS (SELECT event_id, {_T['x']} AS x, {_T['f']} AS f, {_T['m']} AS m FROM events),
b AS (SELECT *, x LIKE '%\\%%' ESCAPE '\\' AS md, x LIKE '%==%' OR x LIKE '%!=%' AS eq, x LIKE 'if %' OR x LIKE '% if %' AS i, x LIKE '%return %' AS ret, x LIKE '%keccak256%' OR x LIKE '%sha256%' AS kec, x LIKE '%require%' OR x LIKE '%revert%' AS req, x LIKE '% > %' OR x LIKE '% >= %' OR x LIKE '% < %' OR x LIKE '% <= %' AS cmp, x LIKE '%last%' OR x LIKE '%prev%' AS lp FROM t WHERE x LIKE '%block.timestamp%' OR x LIKE '%now%'),
c AS (SELECT *, kec OR (md AND i) AS rnd, (req AND cmp) OR (req AND eq AND lp) AS safe, md OR eq OR i OR ret AS used FROM b WHERE (md OR eq OR i OR ret) AND NOT (x LIKE '%=%' AND NOT eq AND NOT i AND NOT ret AND NOT md)),
s AS (SELECT *, CASE WHEN used AND rnd THEN 'High' WHEN used AND safe THEN 'Low' WHEN used AND md THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN used AND rnd THEN 0.9 WHEN used AND safe THEN 0.4 WHEN used AND md THEN 0.85 WHEN used AND (i OR ret) THEN 0.7 ELSE 0.6 END AS score FROM c)
SELECT event_id, severity, CAST(score AS DOUBLE) AS score FROM s WHERE NOT (regexp_matches(f, '^is[A-Z]') AND m IN ('view', 'pure') AND NOT rnd AND score < 0.7) AND NOT (m IN ('view', 'pure') AND score < 0.6)""")
def td_timestamp_findings(spark: SparkSession, d: str) -> DataFrame:
    e, k = B.table(spark, d, "events"), F.col("event_id")
    lines = e.select("event_id", B.chosen(B.STATEMENTS, k).alias("x"), B.chosen(B.FUNCTION_NAMES, F.col("user_id")).alias("f"), B.chosen(B.MUTABILITY, F.expr("event_id div 8")).alias("m"))
    return source_text.timestamp_findings(lines, "f", "m", F.col("x")).select("event_id", "severity", "score")


_A = {"b": B.sql_chosen(B.BODIES, "o_orderkey"), "h": B.sql_chosen(B.HEADERS, "o_orderkey // 3"), "f": B.sql_chosen(B.FUNCTION_NAMES, "o_custkey"), "m": B.sql_chosen(B.MUTABILITY, "o_custkey // 2"), "v": B.sql_chosen(B.VISIBILITY, "o_custkey // 5")}


_SENSITIVE = r"\.transfer\(|\.send\(|\.call\{value:|selfdestruct\(|delegatecall\(|(owner|admin) ?=[^=]|_mint\(|_burn\(|totalSupply (\+|-)?= "


@query(rf"""WITH t AS (SELECT o_orderkey, {_A['b']} AS b, {_A['h']} AS h, {_A['f']} AS f, {_A['m']} AS m, {_A['v']} AS v FROM orders), c AS (SELECT *, regexp_replace(b, '//[^\n]*', '', 'g') AS code, regexp_matches(b, '\.transfer\(|\.send\(|\.call\{{value:') AS pays FROM t)
SELECT o_orderkey, CASE WHEN pays THEN 'unprotected-ether-withdrawal' WHEN regexp_matches(b, '(owner|admin) ?=[^=]') THEN 'unprotected-ownership-change' WHEN b LIKE '%selfdestruct(%' THEN 'unprotected-selfdestruct' ELSE 'missing-access-control' END AS finding_type,
CASE WHEN pays THEN 'High' WHEN regexp_matches(b, '(owner|admin) ?=[^=]') OR b LIKE '%selfdestruct(%' THEN 'Critical' ELSE 'Medium' END AS severity FROM c
WHERE regexp_matches(b, '{_SENSITIVE}') AND NOT (contains(code, 'require') AND contains(code, 'msg.sender') AND regexp_matches(code, 'owner|admin')) AND NOT (contains(code, 'revert') AND regexp_matches(code, 'owner|admin|authorized')) AND NOT (contains(code, 'assert') AND contains(code, 'msg.sender') AND contains(code, 'owner')) AND NOT regexp_matches(code, '(OnlyOwner|Unauthorized|NotOwner)\(\)')
AND NOT regexp_matches(h || ' ' || b, 'only(Owner|Admin|Role|Governance|Minter|Pauser|Controller)|auth|restricted') AND NOT contains(lower(f), 'deposit') AND NOT (contains(lower(f), 'withdraw') AND regexp_matches(b, '(balances|deposits|stakes)\[msg\.sender\]')) AND m NOT IN ('view', 'pure') AND v NOT IN ('private', 'internal')""")
def td_access_findings(spark: SparkSession, d: str) -> DataFrame:
    o, k, c = B.table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    f = o.select("o_orderkey", B.chosen(B.BODIES, k).alias("body"), B.chosen(B.HEADERS, F.expr("o_orderkey div 3")).alias("header"), B.chosen(B.FUNCTION_NAMES, c).alias("func"), B.chosen(B.MUTABILITY, F.expr("o_custkey div 2")).alias("mutability"), B.chosen(B.VISIBILITY, F.expr("o_custkey div 5")).alias("visibility"))
    return source_text.access_findings(f).select("o_orderkey", "finding_type", "severity")


_G = {"c": B.sql_chosen(B.CONDITIONS, "p_partkey"), "b": B.sql_chosen(B.LOOP_BODIES, "p_partkey // 4"), "p": B.sql_chosen(B.PARAMS, "p_size")}


@query(f"""WITH t AS (SELECT p_partkey, {_G['c']} AS c, {_G['b']} AS b, {_G['p']} AS p FROM part), x AS (SELECT *, regexp_extract(c, '(\\w+)\\.length', 1) AS a FROM t)
SELECT p_partkey, CASE WHEN b LIKE '%.transfer(%' THEN 'gas-limit-dos-external-call' WHEN b LIKE '%delete %' THEN 'gas-limit-dos-delete' ELSE 'gas-limit-dos' END AS finding_type, CASE WHEN b LIKE '%.transfer(%' THEN 'Critical' ELSE 'High' END AS severity FROM x
WHERE a <> '' AND (a = 'users' OR p LIKE '%[] memory ' || a || '%' OR p LIKE '%[] calldata ' || a || '%') AND (b LIKE '%+=%' OR b LIKE '%delete %' OR b LIKE '%.transfer(%')""")
def td_gas_limit_loops(spark: SparkSession, d: str) -> DataFrame:
    loops = B.table(spark, d, "part").select("p_partkey", B.chosen(B.CONDITIONS, F.col("p_partkey")).alias("condition"), B.chosen(B.LOOP_BODIES, F.expr("p_partkey div 4")).alias("body"), B.chosen(B.PARAMS, F.col("p_size")).alias("params"))
    return source_text.gas_limit_findings(loops).select("p_partkey", "finding_type", "severity")


@query("""WITH s AS (SELECT p_partkey, CAST(p_size % 9 AS INT) AS a, CAST(p_partkey % 20 AS INT) AS b, CAST(p_partkey % 3 AS INT) AS k FROM part) SELECT p_partkey, a AS minor, CASE WHEN k = 1 THEN 0 ELSE b END AS patch, (0, a, CASE WHEN k = 1 THEN 0 ELSE b END) >= (0, 8, 0) AS checked FROM s WHERE k <> 2""")
def td_pragma_versions(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(3))
    number = F.concat_ws(".", F.lit("0"), (F.col("p_size") % 9).cast("string"), F.when(k != 1, (F.col("p_partkey") % 20).cast("string")))
    source = F.when(k == 2, F.lit("contract A {}")).otherwise(F.concat(F.lit("// x\npragma solidity >="), number, F.lit(" <0.9.0;\ncontract A {}")))
    v = B.table(spark, d, "part").select("p_partkey", rules.version(source).alias("v")).where("v is not null")
    return v.select("p_partkey", F.col("v.minor").alias("minor"), F.col("v.patch").alias("patch"), (F.col("v") >= F.struct(F.lit(0), F.lit(8), F.lit(0))).alias("checked"))


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus = 'O' AS several, o_orderkey % 2 = 0 AS critical, o_orderkey % 5 = 0 AS guarded, o_orderkey % 7 = 0 AS protected, o_orderkey % 11 = 0 AS test FROM orders),
a AS (SELECT *, CAST(0.7 AS FLOAT) + CASE WHEN several THEN CAST(0.1 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS s FROM x), b AS (SELECT *, s + CASE WHEN critical THEN CAST(0.1 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS t FROM a), c AS (SELECT *, t + CASE WHEN protected OR guarded THEN CAST(-0.4 AS FLOAT) ELSE CAST(0 AS FLOAT) END AS u FROM b),
e AS (SELECT *, CASE WHEN guarded THEN least(u, CAST(0.2 AS FLOAT)) ELSE u END AS v FROM c), f AS (SELECT *, greatest(CAST(0 AS FLOAT), least(CAST(1 AS FLOAT), v + CASE WHEN test THEN CAST(-0.3 AS FLOAT) ELSE CAST(0 AS FLOAT) END)) AS w FROM e) SELECT o_orderkey, round(CAST(w AS DOUBLE), 6) AS score, CASE WHEN CAST(w AS DOUBLE) >= 0.8 THEN 'High' WHEN CAST(w AS DOUBLE) >= 0.6 THEN 'Medium' ELSE 'Low' END AS level FROM f""")
def td_reentrancy_confidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = rules.reentrancy_confidence(F.col("o_orderstatus") == "O", k % 2 == 0, k % 5 == 0, k % 7 == 0, k % 11 == 0).cast("double")
    return B.table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", F.round("s", 6).alias("score"), rules.confidence_level(F.col("s")).alias("level"))


@query("""WITH n AS (SELECT s_suppkey, 'f' || s_nationkey AS a, (['f' || s_nationkey, 'f' || s_nationkey || '_uint256', 'f' || s_nationkey || '0', 'g'])[CAST(s_suppkey % 4 AS INT) + 1] AS b FROM supplier) SELECT s_suppkey, a = b OR (starts_with(b, a) AND regexp_full_match(substr(b, length(a) + 1), '_[\\p{L}\\p{N}_]*')) AS same FROM n""")
def td_canonical_names(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat(F.lit("f"), F.col("s_nationkey"))
    b = F.get(F.array(a, F.concat(a, F.lit("_uint256")), F.concat(a, F.lit("0")), F.lit("g")), (F.col("s_suppkey") % 4).cast("int"))
    return B.table(spark, d, "supplier").select("s_suppkey", rules.same_function(a, b).alias("same"))


@query(f"""WITH {B.FINDINGS_SQL} SELECT ord, '- **' || severity || '** (' || confidence || ') ' || scanner_id || ' in ' || function || ' at ' || file || ':' || line AS markdown FROM findings""")
def td_markdown_report(spark: SparkSession, d: str) -> DataFrame:
    f = B.findings(spark, d).withColumn("title", F.concat("scanner_id", F.lit(" in "), F.col("function")))
    return findings.markdown(f).select("ord", "markdown")


def _scanned(detector: detectors.Detector):
    def f(spark: SparkSession, d: str) -> DataFrame:
        found = detector.run(Facts(C.sources(spark, d), keep=["functions"] if detector.again else ()))
        return found.select("file", "scanner_id", "finding_type", "severity", "confidence", "function", "line")

    f.__name__ = "td_scan_" + detector.id.replace("source-", "").replace("-", "_")
    return query(C.findings_sql(detector.id))(f)


for _d in detectors.DETECTORS:
    _scanned(_d)


@query(f"""WITH f AS ({C.findings_sql()}) SELECT scanner_id, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low, count(*) FILTER (severity = 'Informational') AS informational, count(*) AS total FROM f GROUP BY 1""")
def td_scan_all(spark: SparkSession, d: str) -> DataFrame:
    """Every detector of the registry in one plan."""
    return findings.severity_counts(scan.detected(Facts(C.sources(spark, d), keep=("functions", "loops")), scan.selected(every=True)), "scanner_id")


@query(f"""WITH {C.USED}, f(i, visibility, mutability, modifiers, params, fin) AS ({C.values(C.FUNCTION_FACTS)}) SELECT file, name AS func, visibility, mutability, modifiers, params, CAST(base AS BIGINT) AS line, CAST(base + fin AS BIGINT) AS end_line FROM used JOIN f USING (i) JOIN size USING (i)""")
def td_facts_functions(spark: SparkSession, d: str) -> DataFrame:
    f = Facts(C.sources(spark, d)).functions
    return f.select("file", "func", "visibility", "mutability", F.array_join("modifiers", ",").alias("modifiers"), F.array_join(F.transform("params", lambda p: p["name"]), ",").alias("params"), F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"""WITH {C.USED}, f(i, a, b, loop_type, condition, calls, writes, length) AS ({C.values(C.LOOP_FACTS)}) SELECT file, name AS func, loop_type, condition, calls, writes, length, CAST(base + a AS BIGINT) AS line, CAST(base + b AS BIGINT) AS end_line FROM used JOIN f USING (i) JOIN size USING (i)""")
def td_facts_loops(spark: SparkSession, d: str) -> DataFrame:
    f = Facts(C.sources(spark, d)).loops
    return f.select("file", "func", "loop_type", "condition", F.col("contains_external_calls").alias("calls"), F.col("contains_storage_writes").alias("writes"), F.col("iterates_over_length").alias("length"), F.col("line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"""WITH {C.USED}, f(i, a, call_type, target, is_checked) AS ({C.values(C.CALL_FACTS)}) SELECT file, name AS func, call_type, target, is_checked, CAST(base + a AS BIGINT) AS line FROM used JOIN f USING (i) JOIN size USING (i)""")
def td_facts_calls(spark: SparkSession, d: str) -> DataFrame:
    return Facts(C.sources(spark, d)).calls.select("file", "func", "call_type", "target", "is_checked", F.col("line").cast("long").alias("line"))


@query(f"""WITH {C.USED}, f(i, a, left_side, right_side) AS ({C.values(C.ASSIGNMENT_FACTS)}) SELECT file, name AS func, left_side, right_side, CAST(base + a AS BIGINT) AS line FROM used JOIN f USING (i) JOIN size USING (i)""")
def td_facts_assignments(spark: SparkSession, d: str) -> DataFrame:
    return Facts(C.sources(spark, d)).assignments.select("file", "func", "left_side", "right_side", F.col("line").cast("long").alias("line"))


@query(f"""WITH {C.USED} SELECT file, 'onlyOwner' AS name, CAST(max(base + n) AS BIGINT) AS line, true AS is_access_control, coalesce(max(CASE WHEN i = 6 THEN 'setOwner' END), '') AS used_by FROM used JOIN size USING (i) GROUP BY file""")
def td_facts_modifiers(spark: SparkSession, d: str) -> DataFrame:
    """Modifiers, and the functions that are restricted by them."""
    facts = Facts(C.sources(spark, d), keep=["members"])
    used = facts.access_modifiers().groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("func")), ",").alias("used_by"))
    return facts.modifiers.join(used, "file", "left").select("file", "name", F.col("line").cast("long").alias("line"), "is_access_control", F.coalesce("used_by", F.lit("")).alias("used_by"))


@query(f"""WITH {C.USED}, f(i, a, b, loop_type, condition, calls, writes, length) AS ({C.values(C.LOOP_FACTS)}), g(i, c, left_side, right_side) AS ({C.values(C.ASSIGNMENT_FACTS)}) SELECT DISTINCT file, name AS func, CAST(base + a AS BIGINT) AS line FROM used JOIN f USING (i) JOIN g USING (i) JOIN size USING (i) WHERE c > b""")
def td_facts_writes_after_loops(spark: SparkSession, d: str) -> DataFrame:
    return Facts(C.sources(spark, d)).loops_before_assignments().select("file", "func", F.col("line").cast("long").alias("line"))


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return B.findings(spark, d).withColumn("title", F.concat("scanner_id", F.lit(" in "), F.col("function")))


_TITLED = f"{B.FINDINGS_SQL}, t AS (SELECT *, scanner_id || ' in ' || function AS title FROM findings)"


@query(f"""WITH {_TITLED} SELECT ord, '{{"scanner_id":"' || scanner_id || '","severity":"' || severity || '","line":' || line || '}}' AS json FROM t""")
def td_json_findings(spark: SparkSession, d: str) -> DataFrame:
    return render.as_json(_titled(spark, d), "scanner_id", "severity", "line")


@query(f"""WITH {_TITLED}, s(i, severity) AS (VALUES (0, 'Critical'), (1, 'High'), (2, 'Medium'), (3, 'Low'), (4, 'Informational')) SELECT CAST(i AS BIGINT) AS "at", '- ' || s.severity || ': ' || (SELECT count(*) FROM t WHERE t.severity = s.severity) AS line FROM s""")
def td_report_summary(spark: SparkSession, d: str) -> DataFrame:
    return render.summary(_titled(spark, d))


@query(f"""WITH {_TITLED} SELECT ord, '### ' || severity || ': ' || title || chr(10) || chr(10) || '**Scanner:** ' || scanner_id || chr(10) || '**Confidence:** ' || confidence || chr(10) || chr(10) || '**Locations:**' || chr(10) || '- ' || file || ':' || line || chr(10) AS text FROM t""")
def td_report_findings(spark: SparkSession, d: str) -> DataFrame:
    return render.markdown(_titled(spark, d))


@query(f"""WITH {_TITLED}, r AS (SELECT *, row_number() OVER (PARTITION BY severity, title ORDER BY ord, file, line) AS n FROM t) SELECT severity, title, count(*) AS n, string_agg(file || ':' || line, ', ' ORDER BY ord, file, line) FILTER (n <= 3) AS places FROM r GROUP BY 1, 2""")
def td_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return render.by_severity(_titled(spark, d))


@query(f"""WITH {_TITLED} SELECT ord, severity, title FROM t WHERE severity IN ('Critical', 'High') ORDER BY ord LIMIT 5""")
def td_top_titles(spark: SparkSession, d: str) -> DataFrame:
    """The first five titles of a report (a top-k report)."""
    return render.top_titles(_titled(spark, d))


@query(f"""WITH {_TITLED} SELECT ord, '{{"ruleId":"' || scanner_id || '","level":"' || CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || title || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || line || '}}}}}}]}}' AS result FROM t""")
def td_sarif(spark: SparkSession, d: str) -> DataFrame:
    return render.sarif(_titled(spark, d))


@query(f"""WITH {B.FINDINGS_SQL} SELECT ord, 'finding:' || scanner_id || ':' || file || ':' || line || ':' || (ord % 80) AS dedup_key FROM findings""")
def td_dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    f = B.findings(spark, d).withColumns({"finding_type": F.lit("finding"), "column": F.col("ord") % 80})
    return findings.key_string(f).select("ord", "dedup_key")


_KINDS = ("reentrancy-ir", "classic-reentrancy", "missing-access-control", "weak-access-control-tx-origin", "simple-timestamp", "Unauthorized-call", "recursive_call", "owner-change")


def _expand_sql(c: str) -> str:
    r, a = correlate.SYNONYMS["reentrancy"], correlate.SYNONYMS["access_control"]
    any_ = lambda xs: " OR ".join(f"contains({c}, '{x}')" for x in xs)
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"list_distinct([{c}] || CASE WHEN {any_(('reentrancy', *r))} THEN {lst(('reentrancy', *r))} ELSE [] END || CASE WHEN {any_(('access_control', *a))} THEN {lst(('access_control', *a))} ELSE [] END)"


@query(f"""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS o, l_partkey AS pk, {B.sql_chosen(_KINDS, 'l_partkey')} AS t FROM lineitem), j AS (SELECT k, o, t, lead(t) OVER (PARTITION BY k ORDER BY o, pk) AS u FROM p), e AS (SELECT *, {_expand_sql('lower(t)')} AS x, {_expand_sql('lower(u)')} AS y FROM j WHERE u IS NOT NULL)
SELECT k, o, round(CASE WHEN t = u THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 6) AS score FROM e""")
def td_pattern_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Each line of an order with the next one, as findings whose kinds may mean the same."""
    p = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("o"), "l_partkey", B.chosen(_KINDS, F.col("l_partkey")).alias("t"))
    p = p.withColumn("u", F.lead("t").over(Window.partitionBy("k").orderBy("o", "l_partkey"))).where("u IS NOT NULL")
    return p.select("k", "o", F.round(correlate.pattern_score(F.col("t"), F.col("u")), 6).alias("score"))


def td_greedy_groups(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as findings of a file: grouped by how near their minutes are."""
    e = B.table(spark, d, "events").select("event_id", "user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("m"))
    scores = correlate.near_pairs(e, "user_id", "m", "event_id").withColumnRenamed("file", "user_id")
    return correlate.grouped(scores, e, "user_id", "event_id")


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Parts as findings: one brand is a file, a price a line, a type a kind, the name what is said."""
    k = F.col("p_partkey")
    return B.table(spark, d, "part").select("p_partkey", "p_brand", F.pmod(k * 7, F.lit(5000)).alias("line"), F.when(k % 3 == 0, B.chosen(_KINDS, k)).alias("kind"), F.concat_ws(" ", "p_name", "p_type").alias("said"))


@query(f"""WITH t AS (SELECT p_partkey, p_brand, p_partkey * 7 % 5000 AS line, p_name || ' ' || p_type AS text FROM part), w AS (SELECT *, {_WORDS} AS w FROM t),
p AS (SELECT a.p_brand, a.p_partkey AS a, b.p_partkey AS b, 1 - abs(a.line - b.line) / 10.0 AS near, round(0.7 * len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS said FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT p_brand, a, b, CAST(round(greatest(near, said), 6) AS DOUBLE) AS score, CASE WHEN near >= said THEN 'location' ELSE 'semantic' END AS strategy FROM p WHERE near >= 0.5 OR said >= 0.5""")
def td_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return correlate.candidates(_described(spark, d), "p_brand", "p_partkey", "line", "said").withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(f"""WITH k AS (SELECT DISTINCT {B.sql_chosen(_KINDS, 'p_partkey')} AS t FROM part WHERE p_partkey % 3 = 0), e AS (SELECT a.t AS kind, b.t AS other, {_expand_sql('lower(a.t)')} AS x, {_expand_sql('lower(b.t)')} AS y FROM k a, k b),
s AS (SELECT kind, other, CASE WHEN kind = other THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END AS score FROM e) SELECT kind, string_agg(other || ':' || CAST(round(score, 4) AS DECIMAL(6, 4)), ',' ORDER BY other) AS alike FROM s WHERE score >= 0.5 GROUP BY 1""")
def td_kinds_alike(spark: SparkSession, d: str) -> DataFrame:
    a = correlate.alike(_described(spark, d), "kind")
    return a.select("kind", F.array_join(F.transform("alike", lambda x: F.concat(x["other"], F.lit(":"), F.round(x["score"], 4).cast("decimal(6,4)").cast("string"))), ",").alias("alike"))


def td_strategy_groups(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each file in groups by the best of three strategies."""
    return correlate.grouped_by_all(_described(spark, d), "p_brand", "p_partkey", "line", "kind", "said")


def td_strategy_statistics(spark: SparkSession, d: str) -> DataFrame:
    return correlate.by_strategy(td_strategy_groups(spark, d))


QUERIES["td_strategy_groups"], QUERIES["td_strategy_statistics"] = td_strategy_groups, td_strategy_statistics  # one finding after another: the tests hold them against a loop
QUERIES["td_greedy_groups"] = td_greedy_groups  # one finding after another: the tests hold it against a loop


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag = 'N') AS t FROM lineitem GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS findings, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS correlated, count(*) AS groups, count(*) FILTER (t > 1) AS cross_validated FROM g) SELECT *, CASE WHEN groups > 0 THEN round(findings / groups, 6) ELSE 0 END AS mean_size FROM s""")
def td_correlation_statistics(spark: SparkSession, d: str) -> DataFrame:
    return correlate.statistics(B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), (F.col("l_returnflag") == "N").alias("tier")), "tier")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag = 'N') AS t FROM lineitem GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS f, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS c, count(*) AS g, count(*) FILTER (t > 1) AS x FROM g)
SELECT '# Correlation Analysis Report' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '- Total findings: ' || f || chr(10) || '- Correlated findings: ' || c || ' (' || printf('%.1f', 100.0 * c / f) || '%)' || chr(10) || '- Correlation groups: ' || g || chr(10) || '- Average group size: ' || printf('%.1f', round(f / g, 6)) || chr(10) || '- Cross-validated groups: ' || x || chr(10) AS report FROM s""")
def td_correlation_report(spark: SparkSession, d: str) -> DataFrame:
    return correlate.report(correlate.statistics(B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), (F.col("l_returnflag") == "N").alias("tier")), "tier"))


@query("""WITH e AS (SELECT o_orderkey AS finding, o_custkey AS c, o_orderstatus AS kind, split_part(o_orderpriority, '-', 1) || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END AS content, 0.8 + (o_orderkey % 3) * 0.1 AS relevance FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 2 = 1)
SELECT a.c AS o_custkey, a.finding AS a, b.finding AS b, round(avg(CASE WHEN a.content = b.content THEN 1.0 WHEN contains(a.content, b.content) OR contains(b.content, a.content) THEN 0.5 ELSE 0 END * a.relevance * b.relevance), 6) AS overlap, avg(CASE WHEN a.content = b.content THEN 1.0 WHEN contains(a.content, b.content) OR contains(b.content, a.content) THEN 0.5 ELSE 0 END * a.relevance * b.relevance) > 0.7 AS confirms FROM e a JOIN e b ON a.c = b.c AND a.kind = b.kind AND a.finding < b.finding GROUP BY 1, 2, 3""")
def td_evidence_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings, a customer's in one group, statuses as kinds of evidence."""
    o, k = B.table(spark, d, "orders"), F.col("o_orderkey")
    content = F.concat(F.substring_index("o_orderpriority", "-", 1), F.when(k % 3 == 0, F.lit("x")).otherwise(F.lit("")))
    return correlate.overlaps(o.select("o_custkey", k.alias("finding"), F.col("o_orderstatus").alias("kind"), content.alias("content"), (0.8 + (k % 3) * 0.1).alias("relevance")), "o_custkey")


_MARK = f"""CASE WHEN contains(t, '.call{{') OR contains(t, '.call(') THEN '{prompts.CALL}' WHEN starts_with(t, 'balances[') OR contains(t, ' balances[') THEN CASE WHEN contains(t, '=') AND NOT contains(t, '==') AND NOT contains(t, '>=') AND NOT contains(t, '<=') THEN '{prompts.WRITE}' ELSE '' END WHEN contains(t, 'storage') OR contains(t, 'mapping') THEN CASE WHEN contains(t, '=') AND NOT contains(t, '==') THEN '{prompts.WRITE}' ELSE '' END WHEN starts_with(t, 'require(') OR starts_with(t, 'assert(') THEN '{prompts.CHECK}' WHEN contains(t, 'unchecked {{') THEN '{prompts.UNCHECKED}' ELSE '' END"""
_MARKED = (*C.FUNCTIONS, "mapping(address => uint) m;\nstorage x = y;\nif (balances[a] == b) {}\n  assert(x);")


@query(f"""WITH s AS (SELECT p_partkey, unnest(string_split({B.sql_chosen(_MARKED, 'p_partkey')}, chr(10))) AS x, generate_subscripts(string_split({B.sql_chosen(_MARKED, 'p_partkey')}, chr(10)), 1) AS i FROM part), m AS (SELECT *, trim(x) AS t FROM s) SELECT p_partkey, md5(string_agg(lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || x || {_MARK}, chr(10) ORDER BY i)) AS marked FROM m GROUP BY 1""")
def td_marked_source(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "part").select("p_partkey", F.md5(prompts.marked(B.chosen(_MARKED, F.col("p_partkey")))).alias("marked"))


@query(f"""WITH {instructions.SQL} SELECT contract, func, op, count(*) AS n FROM instr WHERE op IN ('Call', 'DelegateCall', 'StorageStore') GROUP BY ALL""")
def td_ir_focus(spark: SparkSession, d: str) -> DataFrame:
    return prompts.in_focus(instructions.instr(spark, d), "reentrancy")


def canned(prompt: str) -> str:
    """A provider for tests: an answer by the length of the prompt."""
    n = len(prompt)
    if n % 7 == 0:
        return "Nothing found."
    return 'Found: {"findings": [{"title": "T%d", "severity": "%s", "confidence": %s, "function": "f", "line": %d, "description": "a } in text"}]} as asked' % (n % 5, ("HIGH", "low")[n % 2], (0.9, 0.4, 0.7)[n % 3], n % 100)


@query("""WITH n AS (SELECT conv_id, turn, length('Find faults in: ' || text) AS n FROM conversations) SELECT conv_id, turn, 'T' || (n % 5) AS title, CASE n % 2 WHEN 0 THEN 'High' ELSE 'Low' END AS severity, n % 100 AS line FROM n WHERE n % 7 <> 0 AND n % 3 <> 1""")
def td_model_findings(spark: SparkSession, d: str) -> DataFrame:
    """Prompts, the answers of a provider for tests, and the findings of a confidence of 0.5 or more in them."""
    c = B.table(spark, d, "conversations").select("conv_id", "turn", prompts.filled("Find faults in: {source}", source=F.col("text")).alias("prompt"))
    found = prompts.findings_of(prompts.answered(c, canned), ["conv_id", "turn"], least=0.5)
    return found.select("conv_id", "turn", "title", "severity", "line")


@query(f"""WITH f AS ({C.findings_sql()}), g AS (SELECT file, function, line, max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) AS s, count(DISTINCT scanner_id) AS n FROM f WHERE scanner_id IN ('source-delegatecall', 'source-dangerous-functions', 'source-unchecked-return') GROUP BY ALL) SELECT file, function, line, (['Informational', 'Low', 'Medium', 'High', 'Critical'])[s + 1] AS severity, n AS scanners FROM g""")
def td_scan_composite(spark: SparkSession, d: str) -> DataFrame:
    """Three detectors as one."""
    facts = Facts(C.sources(spark, d), keep=["functions"])
    parts = [x.run(facts) for x in scan.selected(["source-delegatecall", "source-dangerous-functions", "source-unchecked-return"])]
    return scan.composite(parts).select("file", "function", "line", "severity", F.size("scanners").cast("long").alias("scanners"))


@query(f"""WITH {B.FINDINGS_SQL}, k AS (SELECT *, {B.CATEGORY_SQL} AS category, {RANK} AS r, file || ':' || line AS place FROM findings)
SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(file) = 0 THEN 'file' ELSE 'all' END AS dimension, coalesce(CASE WHEN grouping(severity) = 0 THEN severity WHEN grouping(category) = 0 THEN category WHEN grouping(file) = 0 THEN file END, '') AS value, count(*) AS findings, round(avg(score), 6) AS mean,
['Informational', 'Low', 'Medium', 'High', 'Critical'][max(r) + 1] AS highest, array_to_string(list_sort(list(DISTINCT place))[:3], ',') AS first FROM k GROUP BY GROUPING SETS ((severity), (category), (file), ())""")
def td_analysis_rollup(spark: SparkSession, d: str) -> DataFrame:
    """What an analysis reports by severity, category and file, and over all."""
    f = B.findings(spark, d).withColumn("category", rules.category(F.col("scanner_id")))
    return findings.rolled_up(f, "severity", "category", "file").withColumn("first", F.array_join("first", ","))


@query(f"""WITH {B.FINDINGS_SQL}, t AS (SELECT file, scanner_id, function IN ('isOpen', 'draw') AS model, max({RANK}) AS r FROM findings GROUP BY ALL) SELECT a.file, a.scanner_id AS detector, b.scanner_id AS model, a.r = b.r AS agree FROM t a JOIN t b USING (file) WHERE NOT a.model AND b.model""")
def td_cross_checked(spark: SparkSession, d: str) -> DataFrame:
    """Detectors and models that report in one file (findings of two functions stand for a model's)."""
    return findings.cross_checked(B.findings(spark, d).withColumn("tier", F.col("function").isin("isOpen", "draw")), "file", "tier")


@query("""SELECT s_nationkey || '/' || s_suppkey || '.txt' AS path, 'written' AS status, CAST(octet_length(encode(s_name || chr(10) || s_suppkey)) AS BIGINT) AS bytes, md5(s_name || chr(10) || s_suppkey) AS digest FROM supplier""")
def td_emit_tree(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as files in folders by nation, written by the tree writer and read back."""
    s = B.table(spark, d, "supplier").select(F.concat_ws("/", F.col("s_nationkey").cast("string"), F.concat("s_suppkey", F.lit(".txt"))).alias("path"), F.concat_ws("\n", "s_name", F.col("s_suppkey").cast("string")).alias("content"))
    folder = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    manifest = tree.emit(s, folder)
    return tree.read_back(manifest, folder).join(manifest, "path").select("path", "status", "bytes", F.md5("content").alias("digest"))


QUERIES |= instructions.QUERIES | flows.QUERIES
ORACLE_SQL |= instructions.ORACLE_SQL | flows.ORACLE_SQL
