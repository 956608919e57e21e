"""Contracts made from the driver's table part, one file a row, and what their functions are expected to show.

A file has two functions of FUNCTIONS, chosen by its key; a quarter of the files are of a version without checked arithmetic.
EXPECTED and the fact tables below were written by hand for each function; the SQL places them in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as B

FIRST = 5  # line of the first function
FUNCTIONS = (
    'function take() public {\n    (bool ok, ) = msg.sender.call{value: bal[msg.sender]}("");\n    bal[msg.sender] = 0;\n}\n',
    "function payAll(address payable[] memory users) external {\n    for (uint i = 0; i < users.length; i++) {\n        users[i].transfer(share * 2);\n        total += share;\n    }\n    last = total;\n}\n",
    "function burnDown(uint256 amount) external {\n    unchecked {\n        balances[msg.sender] -= amount;\n        total += 1;\n    }\n}\n",
    "function kill(address payable to, address logic) public {\n    logic.delegatecall(msg.data);\n    selfdestruct(to);\n}\n",
    "function drawWinner() public {\n    if (block.timestamp % 7 == 0) {\n        seed = uint256(keccak256(abi.encodePacked(block.timestamp, block.difficulty)));\n    }\n}\n",
    "function sweep(address t, address to) external {\n    IERC20(t).transfer(to, 5);\n    payable(to).send(1);\n    bool done = IERC20(t).transferFrom(to, t, 1);\n}\n",
    "function setOwner(address next) external onlyOwner {\n    owner = next;\n}\n",
    "function changeOwner(address next) public { // owner == next\n    owner = next;\n}\n",
    "function reset(uint256[] calldata data) external {\n    for (uint i = 0; i < data.length; i++) {\n        sums[i] = data[i] * rate / 3;\n        count = count + 1;\n        delete old[i];\n        flag[i] = 1;\n    }\n}\n",
    "function deposit() external payable {\n    balances[msg.sender] += msg.value; /* owner =\n x */\n}\n",
    "function raw(address logic) internal {\n    assembly {\n        let r := delegatecall(gas(), logic, 0, 0, 0, 0)\n    }\n    do {\n        step = step + 1;\n    } while (step < 9);\n}\n",
    'function randomPick() external view returns (uint256) {\n    require(block.timestamp >= end, "early");\n    return block.number % 5;\n}\n',
    "function spread(address payable[] memory to) external {\n    for (uint i = 0; i < to.length; i++) to[i].transfer(1);\n    if (open) while (left > 0) left--;\n    done = true;\n}\n",
    "function grant(uint256 a, function(uint256) external f) public onlyRole(keccak256(abi.encode(a))) returns (bytes memory) {\n    owner = address(uint160(a));\n}\n",
    "function quote(uint256 amount) external view virtual returns (uint256 price);\n",
    "function settle(address to) internal {\n    require(open);\n    to.staticcall(data);\n    if (done) {\n        to.staticcall(data);\n    }\n}\n",
)
N = len(FUNCTIONS)
NAMES = ("take", "payAll", "burnDown", "kill", "drawWinner", "sweep", "setOwner", "changeOwner", "reset", "deposit", "raw", "randomPick", "spread", "grant", "quote", "settle")
#: (function, detector, line from the function's on, finding type, severity, confidence, only without checked arithmetic)
EXPECTED = (
    (0, "classic-reentrancy", 1, "classic-reentrancy", "High", "High", False), (1, "classic-reentrancy", 1, "classic-reentrancy", "High", "High", False), (1, "source-loop-reentrancy", 1, "source-loop-reentrancy", "High", "High", False),
    (1, "source-integer-overflow", 2, "integer-overflow-multiplication-loop", "High", "High", True), (1, "source-integer-overflow", 3, "integer-overflow-accumulation", "Medium", "Medium", True),
    (8, "source-integer-overflow", 2, "integer-overflow-multiplication-loop", "High", "High", True), (8, "source-integer-overflow", 2, "integer-overflow-mul-div", "Medium", "High", True),
    (3, "source-unchecked-return", 1, "unchecked-lowlevel-call-source", "Medium", "High", False), (5, "source-unchecked-return", 1, "unchecked-return-source", "Medium", "High", False), (5, "source-unchecked-return", 2, "unchecked-send-source", "Medium", "High", False),
    (15, "source-unchecked-return", 4, "unchecked-lowlevel-call-source", "Medium", "High", False),
    (3, "source-dangerous-functions", 1, "dangerous-delegatecall-source", "High", "High", False), (3, "source-dangerous-functions", 2, "dangerous-selfdestruct-source", "High", "High", False), (10, "source-dangerous-functions", 1, "dangerous-assembly-source", "Medium", "High", False),
    (3, "source-delegatecall", 1, "delegatecall-to-user-controlled", "Critical", "High", False),
    (1, "source-dos-vulnerabilities", 1, "dos-external-call-loop-source", "High", "High", False), (8, "source-dos-vulnerabilities", 1, "dos-gas-limit-loop-source", "Medium", "Medium", False),
    (1, "ast-dos-vulnerabilities", 1, "dos-external-call-loop-ast", "High", "High", False), (1, "ast-dos-vulnerabilities", 1, "dos-unbounded-loop-ast", "Medium", "High", False), (8, "ast-dos-vulnerabilities", 1, "dos-gas-limit-loop-ast", "High", "High", False), (8, "ast-dos-vulnerabilities", 1, "dos-unbounded-loop-ast", "Medium", "High", False),
    (1, "source-gas-limit-dos", 1, "gas-limit-dos-external-call", "Critical", "High", False), (8, "source-gas-limit-dos", 1, "gas-limit-dos-delete", "High", "High", False),
    (0, "source-missing-access-control", 1, "unprotected-ether-withdrawal", "High", "High", False), (1, "source-missing-access-control", 2, "unprotected-ether-withdrawal", "High", "High", False), (3, "source-missing-access-control", 1, "unprotected-selfdestruct", "Critical", "High", False),
    (5, "source-missing-access-control", 1, "unprotected-ether-withdrawal", "High", "High", False), (7, "source-missing-access-control", 1, "unprotected-ownership-change", "Critical", "High", False),
    (4, "simple-timestamp", 1, "simple-timestamp", "High", "High", False),
    (4, "source-time-vulnerabilities", 1, "timestamp-source", "High", "High", False), (4, "source-time-vulnerabilities", 2, "block-difficulty-source", "High", "High", False), (4, "source-time-vulnerabilities", 2, "timestamp-randomness-source", "High", "High", False),
    (11, "source-time-vulnerabilities", 1, "timestamp-source", "Medium", "High", False), (11, "source-time-vulnerabilities", 2, "block-number-randomness-source", "Medium", "High", False),
    (12, "classic-reentrancy", 1, "classic-reentrancy", "High", "High", False), (12, "source-loop-reentrancy", 1, "source-loop-reentrancy", "High", "High", False), (12, "source-dos-vulnerabilities", 1, "dos-external-call-loop-source", "High", "High", False),
    (12, "ast-dos-vulnerabilities", 1, "dos-external-call-loop-ast", "High", "High", False), (12, "ast-dos-vulnerabilities", 1, "dos-unbounded-loop-ast", "Medium", "High", False), (12, "source-gas-limit-dos", 1, "gas-limit-dos-external-call", "Critical", "High", False), (12, "source-missing-access-control", 1, "unprotected-ether-withdrawal", "High", "High", False),
    (2, "unchecked-arithmetic", 2, "unchecked-arithmetic", "Critical", "High", False), (2, "unchecked-arithmetic", 3, "unchecked-arithmetic", "Medium", "Medium", False), (2, "source-unchecked-overflow", 1, "unchecked-arithmetic", "High", "High", False),
)
#: (function, visibility, mutability, modifiers, parameters, last line)
FUNCTION_FACTS = (
    (0, "public", "", "", "", 3), (1, "external", "", "", "users", 6), (2, "external", "", "", "amount", 5), (3, "public", "", "", "to,logic", 3), (4, "public", "", "", "", 4), (5, "external", "", "", "t,to", 4),
    (6, "external", "", "onlyOwner", "next", 2), (7, "public", "", "", "next", 2), (8, "external", "", "", "data", 7), (9, "external", "payable", "", "", 3), (10, "internal", "", "", "logic", 7), (11, "external", "view", "", "", 3),
    (12, "external", "", "", "to", 4), (13, "public", "", "onlyRole", "a,f", 2), (14, "external", "view", "", "amount", 0), (15, "internal", "", "", "to", 6),
)
#: (function, line, last line, type, condition, calls, writes, length)
LOOP_FACTS = ((1, 1, 4, "For", "i < users.length", True, False, True), (8, 1, 6, "For", "i < data.length", False, True, True), (10, 4, 6, "DoWhile", "step < 9", False, False, False), (12, 1, 1, "For", "i < to.length", True, False, True), (12, 2, 2, "While", "left > 0", False, False, False))
#: (function, line, type, target, checked)
CALL_FACTS = (
    (0, 1, "Call", "msg.sender", True), (1, 2, "Transfer", "users[i]", False), (3, 1, "DelegateCall", "logic", False), (5, 1, "ERC20Transfer", "IERC20(t)", False), (5, 2, "Send", "payable(to)", False), (5, 3, "ERC20TransferFrom", "IERC20(t)", True),
    (12, 1, "Transfer", "to[i]", False), (15, 2, "StaticCall", "to", True), (15, 4, "StaticCall", "to", False),
)
#: (function, line, left side, right side)
ASSIGNMENT_FACTS = (
    (0, 2, "bal[msg.sender]", "0"), (1, 5, "last", "total"), (4, 2, "seed", "uint256(keccak256(abi.encodePacked(block.timestamp, block.difficulty)))"), (6, 1, "owner", "next"), (7, 1, "owner", "next"),
    (8, 2, "sums[i]", "data[i] * rate / 3"), (8, 3, "count", "count + 1"), (8, 5, "flag[i]", "1"), (10, 5, "step", "step + 1"), (12, 3, "done", "true"), (13, 1, "owner", "address(uint160(a))"),
)
HEAD = "contract C{key} {\n    address owner;\n    uint256 total;\n"
MODIFIER = "    modifier onlyOwner() { require(msg.sender == owner); _; }\n"


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(file, content)."""
    k = F.col("p_partkey")
    first = F.pmod(k, F.lit(N))
    second = F.pmod(first + 1 + F.pmod(F.expr(f"p_partkey div {N}"), F.lit(N - 1)), F.lit(N))
    version = F.when(k % 4 == 0, "pragma solidity ^0.7.6;\n").otherwise("pragma solidity ^0.8.20;\n")
    before, after = HEAD.split("{key}")
    content = F.concat(version, F.lit(before), k.cast("string"), F.lit(after), B.chosen(FUNCTIONS, first), B.chosen(FUNCTIONS, second), F.lit(MODIFIER), F.lit("}\n"))
    return B.table(spark, d, "part").select(F.concat(F.lit("src/C"), k, F.lit(".sol")).alias("file"), content.alias("content"))


def _value(x) -> str:
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


#: used: (file, k, i, base): function i of file's begins on line base.
USED = f"""size(i, n, name) AS ({values((i, f.count(chr(10)), NAMES[i]) for i, f in enumerate(FUNCTIONS))}),
pick AS (SELECT p_partkey AS k, 'src/C' || p_partkey || '.sol' AS file, p_partkey % {N} AS a, (p_partkey % {N} + 1 + (p_partkey // {N}) % {N - 1}) % {N} AS b FROM part),
used AS (SELECT k, file, a AS i, {FIRST} AS base FROM pick UNION ALL SELECT k, file, b, {FIRST} + n FROM pick JOIN size ON i = a)"""


def findings_sql(detector: str | None = None) -> str:
    """The findings as rows (file, scanner_id, finding_type, severity, confidence, function, line)."""
    rows = [r for r in EXPECTED if detector in (None, r[1])]
    return f"""WITH {USED}, want(i, scanner_id, dl, finding_type, severity, confidence, old) AS ({values(rows)})
SELECT file, scanner_id, finding_type, severity, confidence, name AS function, CAST(base + dl AS BIGINT) AS line FROM used JOIN want USING (i) JOIN size USING (i) WHERE NOT old OR k % 4 = 0"""
