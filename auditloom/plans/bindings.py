"""Driver tables seen as the audit's relations. Each binding is a projection of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCANNERS = ("classic-reentrancy", "source-access-control", "unchecked-return", "simple-timestamp", "source-dos", "gas-report")
#: Statements that stand for an event or an order: detectors run on the text, not on the number that chose it.
STATEMENTS = (
    "if (now % 2 == 0) { win(); }", "return block.timestamp;", "require(block.timestamp >= last + 5);", "x = keccak256(block.timestamp);", "uint t = now;",
    "while (block.timestamp > end) { step(); }", "if (block.timestamp > end) { stop(); }", "emit Ping();",
)
FUNCTION_NAMES = ("isOpen", "draw", "withdraw", "getState", "setOwner", "deposit", "kill", "sweep")
MUTABILITY = ("", "view", "payable")
VISIBILITY = ("public", "external", "internal")
BODIES = (
    "{ owner = next; }", "{ msg.sender.transfer(1 ether); }", "{ require(msg.sender == owner); owner = next; }", "{ selfdestruct(payable(to)); }", "{ /* owner = x */ emit Ping(); }",
    "{ balances[msg.sender] = 0; msg.sender.call{value: 1}(''); }", "{ _mint(to, 5); }", "{ revert NotOwner(); }",
    "{ owner =next; }", "{ _burn(a, 1); // author\n }", "{ assert(msg.sender == owner); owner = next; }", "{ if (x) revert Unauthorized(); _mint(a, 1); }", "{ totalSupply += 1; // require(msg.sender == owner)\n }", "{ to.send(1); if (!authorized) revert(); }", "{ admin == next; }", "{ stakes[msg.sender] = 0; to.delegatecall(x); }",
)
HEADERS = ("function f() ", "function f() onlyOwner ")
CONDITIONS = ("i < users.length", "i < list.length", "i < 10", "i < data.length")
LOOP_BODIES = ("sum += data[i];", "users[i].transfer(1);", "delete users[i];", "emit Ping();")
PARAMS = ("", "address[] memory list", "uint[] calldata data")


def chosen(values: tuple, by: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))


def sql_chosen(values: tuple, by: str) -> str:
    return f"([{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}])[CAST(({by}) % {len(values)} AS INT) + 1]"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as findings: a supplier is a file, a part a line, its discount the score."""
    l = table(spark, d, "lineitem")
    score = F.round(F.col("l_discount") * 10, 2)
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        chosen(SCANNERS, F.col("l_partkey") + F.col("l_linenumber")).alias("scanner_id"),
        F.when(F.col("l_quantity") >= 45, "Critical").when(F.col("l_quantity") >= 30, "High").when(F.col("l_quantity") >= 15, "Medium").when(F.col("l_quantity") >= 5, "Low").otherwise("Informational").alias("severity"),
        F.when(score >= 0.8, "High").when(score >= 0.4, "Medium").otherwise("Low").alias("confidence"),
        score.alias("score"),
        F.concat(F.lit("contracts/S"), F.col("l_suppkey"), F.lit(".sol")).alias("file"),
        F.col("l_partkey").alias("line"),
        chosen(FUNCTION_NAMES, F.col("l_orderkey")).alias("function"),
    )


FINDINGS_SQL = f"""findings AS (SELECT l_orderkey * 10 + l_linenumber AS ord, {sql_chosen(SCANNERS, 'l_partkey + l_linenumber')} AS scanner_id,
  CASE WHEN l_quantity >= 45 THEN 'Critical' WHEN l_quantity >= 30 THEN 'High' WHEN l_quantity >= 15 THEN 'Medium' WHEN l_quantity >= 5 THEN 'Low' ELSE 'Informational' END AS severity,
  CASE WHEN round(l_discount * 10, 2) >= 0.8 THEN 'High' WHEN round(l_discount * 10, 2) >= 0.4 THEN 'Medium' ELSE 'Low' END AS confidence,
  round(l_discount * 10, 2) AS score, 'contracts/S' || l_suppkey || '.sol' AS file, l_partkey AS line, {sql_chosen(FUNCTION_NAMES, 'l_orderkey')} AS function FROM lineitem)"""
PRIORITY_SQL = "CAST(CASE severity WHEN 'Critical' THEN 1000 WHEN 'High' THEN 100 WHEN 'Medium' THEN 10 WHEN 'Low' THEN 1 ELSE 0 END * CASE confidence WHEN 'High' THEN 10 WHEN 'Medium' THEN 5 ELSE 1 END AS BIGINT)"
CATEGORY_SQL = "CASE WHEN scanner_id LIKE '%reentrancy%' THEN 'reentrancy' WHEN scanner_id LIKE '%access%' THEN 'access-control' WHEN scanner_id LIKE '%unchecked%' THEN 'unchecked' WHEN scanner_id LIKE '%dos%' THEN 'dos' WHEN scanner_id LIKE '%time%' THEN 'time' ELSE split_part(scanner_id, '-', 1) END"
