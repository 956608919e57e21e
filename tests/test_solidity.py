from pyspark.sql import functions as F

from auditloom.functions import rules
from auditloom.operators import correlate, graph, source_text
from auditloom.sources import solidity
from auditloom.streaming import incremental

WALLET = """pragma solidity ^0.8.20;
// contract Ghost { function ghost() public {} }
contract VulnerableWallet {
    address public owner;
    mapping(address => uint256) deposits;

    constructor() { owner = msg.sender; }

    function deposit() external payable {
        deposits[msg.sender] += msg.value; // owner = x
    }

    function withdraw(uint256 amount)
        external
    {
        if (amount > 0) {
            payable(msg.sender).transfer(amount);
        }
    }

    function changeOwner(address next) public { owner = next; }

    function guarded(address next) public onlyOwner { owner = next; }

    function total() public view returns (uint256) { return address(this).balance; }

    function later() external;
}

library Tools {
    function draw() internal {
        if (block.timestamp % 2 == 0) { win(); }
        uint256 t = block.timestamp;
    }
}
"""


def sources(spark):
    return spark.createDataFrame([("a/Wallet.sol", WALLET), ("b/Empty.sol", ""), ("c/Null.sol", None)], "file string, content string")


def test_functions(spark):
    got = {(r.contract, r.func): (r.visibility, r.mutability, r.line, r.body) for r in source_text.functions_of(sources(spark)).collect()}
    assert {k: v[:3] for k, v in got.items()} == {
        ("VulnerableWallet", "constructor"): ("internal", "", 7), ("VulnerableWallet", "deposit"): ("external", "payable", 9), ("VulnerableWallet", "withdraw"): ("external", "", 13),
        ("VulnerableWallet", "changeOwner"): ("public", "", 21), ("VulnerableWallet", "guarded"): ("public", "", 23), ("VulnerableWallet", "total"): ("public", "view", 25), ("Tools", "draw"): ("internal", "", 31),
    }
    assert "transfer(amount)" in got["VulnerableWallet", "withdraw"][3] and "owner = x" not in got["VulnerableWallet", "deposit"][3]


def test_detectors(spark):
    f = source_text.functions_of(sources(spark))
    assert {(r.func, r.finding_type, r.severity) for r in source_text.access_findings(f).collect()} == {("withdraw", "unprotected-ether-withdrawal", "High"), ("changeOwner", "unprotected-ownership-change", "Critical")}
    lines = f.select("func", "mutability", F.explode(F.split("body", "\n")).alias("x"))
    assert [(r.severity, r.score) for r in source_text.timestamp_findings(lines, "func", "mutability", F.col("x")).collect()] == [("High", 0.9)]


def test_versions(spark):
    rows = [("pragma solidity ^0.8.20;", (0, 8, 20)), ("pragma solidity >=0.6.0 <0.9.0;", (0, 6, 0)), ("pragma solidity 0.7;", (0, 7, 0)), ("x", None)]
    got = spark.createDataFrame(rows, "s string, v struct<a:int,b:int,c:int>").select(rules.version(F.col("s")).alias("got"), "v").collect()
    assert all((r.got and tuple(r.got)) == (r.v and tuple(r.v)) for r in got)


def test_pairs_near_each_other(spark):
    points = [("f", 10, 1), ("f", 19, 2), ("f", 20, 3), ("f", 50, 4), ("g", 10, 5), ("f", 10, 6)]
    got = {(r.a, r.b): round(r.score, 3) for r in correlate.near_pairs(spark.createDataFrame(points, "file string, line int, o int"), "file", "line", "o").collect()}
    assert got == {(1, 2): 0.1, (2, 3): 0.9, (1, 6): 1.0, (2, 6): 0.1}


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (3, 5)], "src long, dst long")
    got = {(r.node, r.depth) for r in graph.depths(edges, spark.createDataFrame([(1,)], "root long")).collect()}
    assert got == {(1, 0), (2, 1), (4, 1), (3, 2), (5, 3)}
    assert [tuple(r) for r in graph.back_edges(edges).collect()] == [(1, 1, 3)]
    assert sorted(tuple(r.path) for r in graph.paths(edges, spark.createDataFrame([(1,)], "node long"), 3).collect()) == [(1,), (1, 2), (1, 2, 3), (1, 2, 3, 5), (1, 4)]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "src" / "sub").mkdir(parents=True)
    (tmp_path / "src" / "sub" / "w.sol").write_text(WALLET)
    (tmp_path / "src" / "note.txt").write_text("contract No {}")
    src = solidity.read(spark, str(tmp_path / "src"))
    assert [r.contract for r in solidity.contract_names(src).collect()] == ["VulnerableWallet", "Tools"]
    detect = lambda df: source_text.access_findings(source_text.functions_of(df))
    incremental.scan(solidity.read_stream(spark, str(tmp_path / "src")), detect, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r.func for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"withdraw", "changeOwner"}
