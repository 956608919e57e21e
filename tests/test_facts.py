import random

from pyspark.sql import functions as F

from auditloom.functions import rules
from auditloom.operators import correlate, detectors, findings, graph, prompts
from auditloom.operators.facts import Facts, pieces
from auditloom.plans import catalog, scan

AUCTION = """pragma solidity ^0.8.0;
contract Auction is Base, Other {
    string s = "a { brace; // no comment";
    modifier onlyAdmin(address a) { require(a == msg.sender); _; }
    modifier notPaused { _; }
    function a(address[] memory to) external onlyAdmin(msg.sender) notPaused returns (uint256 total) {
        for (uint i = 0; i < to.length; i++) { to[i].call{value: 1}(""); }
        while (x < f(1)) { y = 1; z.w = 2; v[1] = 3; }
    }
    function b() public {
        msg.sender.transfer(1); a.transfer(1); c.transfer(2);
    }
    function withdraw(uint256 amount) external nonReentrant {
        msg.sender.call{value: amount}("");
        balances[msg.sender] = 0;
    }
    function ordered() external {
        balances[msg.sender] = 0;
        msg.sender.call{value: 1}("");
        last = 1;
    }
}
contract TestThing { function kill() public { selfdestruct(a); } }
"""


def sources(spark):
    return spark.createDataFrame([("x.sol", AUCTION), ("empty.sol", ""), ("null.sol", None), ("odd.sol", "}}{ function x( {")], "file string, content string")


def test_functions_and_modifiers(spark):
    f = Facts(sources(spark))
    got = {(r.contract, r.func): (r.visibility, r.modifiers, [p.name for p in r.params], [p.name for p in r.returns], r.line, r.end_line) for r in f.functions.where("file = 'x.sol'").collect()}
    assert got["Auction", "a"] == ("external", ["onlyAdmin", "notPaused"], ["to"], ["total"], 6, 9) and got["TestThing", "kill"][0] == "public" and len(got) == 5
    assert {(r.name, r.is_access_control) for r in f.modifiers.collect()} == {("onlyAdmin", True), ("notPaused", False)}
    assert [r.func for r in f.functions_with_modifier("nonReentrant").collect()] == ["withdraw"]
    assert [(r.func, r.modifiers) for r in f.access_modifiers().collect()] == [("a", ["onlyAdmin"])]


def test_loops_and_calls(spark):
    f = Facts(sources(spark))
    assert sorted((r.loop_type, r.condition, r.contains_external_calls, r.contains_storage_writes, r.iterates_over_length) for r in f.loops.collect()) == [("For", "i < to.length", True, False, True), ("While", "x < f(1)", False, True, False)]
    assert f.calls.where("func = 'b'").count() == 3 and {r.call_type for r in f.calls.where("func = 'b'").collect()} == {"Transfer"}
    assert [r.line for r in f.loops_before_assignments().collect()] == [7]  # the second loop assigns after the first one's end


def test_a_call_is_checked_by_the_innermost_block(spark):
    body = """contract K {
    function f() public { require(a); x.send(1); if (b) { y.send(2); } }
    function g() public { if (b) { require(c); y.send(3); } x.send(4); for (;;) { z.send(5); assert(d); } }
    function h() public { while (b) { { require(c); } y.send(6); } }
    function i() public { x.send(7); } function j() public { require(a); }
}
"""
    c = Facts(spark.createDataFrame([("k.sol", body)], "file string, content string")).calls.collect()
    # the block of y.send(6) has another one with a requirement in it, and a text contains what is in its inner blocks
    assert {(r.func, r.target, r.is_checked) for r in c} == {("f", "x", True), ("f", "y", False), ("g", "y", True), ("g", "x", True), ("g", "z", True), ("h", "y", True), ("i", "x", False)}


def test_scan(spark):
    found = scan.ordered(scan.scan(sources(spark))).collect()
    kinds = {(r.scanner_id, r.function) for r in found}
    assert ("classic-reentrancy", "withdraw") not in kinds  # guarded
    assert ("classic-reentrancy", "ordered") not in kinds  # a write comes before the call
    assert not any(r.contract == "TestThing" for r in found) and [r.priority for r in found] == sorted((r.priority for r in found), reverse=True)
    assert {r.function for r in scan.detected(Facts(sources(spark)), scan.selected(["classic-reentrancy"])).collect()} == {"withdraw", "ordered"}
    assert {(r.file, r.status, r.contracts) for r in scan.files(sources(spark)).collect()} == {("x.sol", "ok", 2), ("empty.sol", "no contract", 0), ("null.sol", "unreadable", 0), ("odd.sol", "no contract", 0)}


def test_a_failing_detector_is_left_out(spark):
    bad = detectors.Detector("bad", "High", "High", lambda facts: facts.functions.select("no such column"))
    failed = []
    out = scan.detected(Facts(sources(spark)), [bad, *scan.selected(["source-dangerous-functions"])], failed)
    assert out.count() == 1 and [x for x, _ in failed] == ["bad"]
    assert scan.detected(Facts(sources(spark)), []).count() == 0
    assert scan.sequential(Facts(sources(spark)), scan.selected(["source-dangerous-functions", "source-delegatecall"]), lambda df: not df.isEmpty()).count() == 1
    assert [x.id for x in scan.selected(least_severity="Critical")] == ["source-delegatecall", "source-gas-limit-dos", "source-missing-access-control"] and scan.listed(spark).count() == len(detectors.DETECTORS)


def test_best_of_a_bucket(spark):
    """The greatest score stays; of equal ones the lowest priority, then the last."""
    rows = [(1, "a-reentrancy", "Critical", "High", 0.9, "f", 42), (2, "b-reentrancy", "Low", "High", 0.9, "f", 44), (3, "c-reentrancy", "Low", "High", 0.9, "f", 44), (4, "access", "Low", "High", 0.2, "f", 44), (5, "a-reentrancy", "High", "High", 0.9, "f", 45)]
    df = spark.createDataFrame(rows, "ord long, scanner_id string, severity string, confidence string, score double, file string, line long")
    assert {r.ord for r in findings.deduplicated(df).collect()} == {3, 4, 5}


def test_greedy_groups_are_those_of_a_loop(spark):
    r = random.Random(3)
    rows = [(f, i) for f in "ab" for i in range(40)]
    scores = [(f, i, j, round(r.random(), 3)) for f in "ab" for i in range(40) for j in range(i + 1, 40) if r.random() < 0.1]
    got = {(x.f, x.o): x.group for x in correlate.grouped(spark.createDataFrame(scores, "f string, a long, b long, score double"), spark.createDataFrame(rows, "f string, o long"), "f", "o").collect()}
    want, of = {}, {(f, a, b): s for f, a, b, s in scores}
    for f, i in rows:
        best, at = 0.0, i
        groups = sorted({want[f, j] for j in range(i)})
        for g in groups:
            s = max((of.get((f, j, i), 0.0) for j in range(i) if want[f, j] == g), default=0.0)
            if s > best and s >= 0.5:
                best, at = s, g
        want[f, i] = at
    assert got == want


def test_paths_that_part(spark):
    rows = [(1, [1, 2, 3], 3, None), (1, [1, 2, 4], None, 4), (1, [1, 5], None, None), (2, [7, 8], 8, None)]
    got = graph.diverging(spark.createDataFrame(rows, "start long, path array<long>, call long, write long")).collect()
    assert [(x.start, x.call, x.write, x.parts_at) for x in got] == [(1, 3, 4, 2)]


def test_loops_of_a_flow(spark):
    edges = spark.createDataFrame([("f", a, b) for a, b in [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5)]], "f string, src long, dst long")
    found = graph.loops(edges, ["f"])
    assert {(x.header, tuple(x.body), tuple(x.exits)) for x in found.collect()} == {(1, (1, 2), (3,)), (3, (3, 4), (5,))}
    writes = spark.createDataFrame([("f", 5), ("f", 0)], "f string, block long")
    assert {(x.header, tuple(x.writes)) for x in graph.writes_after(found, edges, writes, ["f"]).collect()} == {(1, (5,)), (3, (5,))}


def test_answers(spark):
    tries = {"n": 0}

    def ask(prompt):
        tries["n"] += 1
        if prompt == "bad" or tries["n"] % 2:
            raise OSError("busy")
        return '```json\n{"findings": [{"title": "T", "severity": "HIGH", "confidence": 0.4}]}\n```'

    df = spark.createDataFrame([(1, "x"), (2, "bad")], "id long, prompt string").coalesce(1)
    out = prompts.answered(df, ask, pause=0.0)
    assert {(r.id, r.answer is None, r.error) for r in out.collect()} == {(1, False, None), (2, True, "OSError: busy")}
    assert [(r.id, r.title, r.severity) for r in prompts.findings_of(out, ["id"]).collect()] == [(1, "T", "High")]
    assert prompts.findings_of(out, ["id"], least=0.5).count() == 0
    texts = [('x ' + '{"a": ' * 30 + '1' + '}' * 30 + ' }', '{"a": ' * 30 + '1' + '}' * 30), ('{"a": "open } {', '{"a": "open } {'), ('no json', 'no json'), ('a {"x": "}\\"{"} b {', '{"x": "}\\"{"}'), ("```\n[1]\n```", "[1]"), ("{ open", "{ open")]
    assert all(r.got == r.want for r in spark.createDataFrame(texts, "t string, want string").select("want", prompts.json_of(F.col("t")).alias("got")).collect())


def test_scores(spark):
    row = spark.range(1).select(rules.access_confidence(F.lit(True), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(False)).alias("a"), rules.unchecked_confidence(F.lit(True), F.lit(False), F.lit(False), F.lit(True)).alias("u")).first()
    assert round(row.a, 4) == 1.0 and round(row.u, 4) == 0.7


ODD = """interface I { function quote(uint a) external view returns (uint); function two() external; }
abstract contract K is I {
    modifier late(uint x) virtual;
    function one(uint a, function(uint) external f, mapping(uint => uint) storage m) public onlyRole(keccak256(abi.encode(a, 1))) late(f(a)) returns (bytes memory, uint b) { owner = a; }
    function many(address[] calldata xs) external {
        for (uint i = 0; i < xs.length; i++) xs[i].transfer(1);
        while (a > 0) a--;
        if (x) { y = 1; } else if ((a + (b)) > 1) for (uint j = 0; j < g(h(2)); j++) if (xs[j] == (k)) { a = 1; b = 2; c = 3; }
        do { for (;;) { while (t(u(v))) { z = 1; } } } while (n < 3);
        while (m > 1) { do step(); while (q); }
    }
    function unclosed() public { x = 1; }
}"""


def test_headers_by_depth_and_statements_without_braces(spark):
    f = Facts(spark.createDataFrame([("o.sol", ODD)], "file string, content string"))
    got = {r.func: r for r in f.functions.collect()}
    assert set(got) == {"quote", "two", "one", "many", "unclosed"} and got["quote"].body == "" and (got["quote"].contract, got["quote"].mutability, got["two"].visibility) == ("I", "view", "external")
    one = got["one"]
    assert (one.visibility, one.modifiers) == ("public", ["onlyRole", "late"])
    assert [(p.type_name, p.name) for p in one.params] == [("uint", "a"), ("function(uint)", "f"), ("mapping(uint => uint)", "m")]
    assert [(p.type_name, p.name) for p in one.returns] == [("bytes", ""), ("uint", "b")]
    assert [(r.name, r.body) for r in f.modifiers.collect()] == [("late", "")]
    loops = sorted((r.line, r.pos, r.end_line, r.loop_type, r.condition, r.contains_external_calls, r.contains_storage_writes) for r in f.loops.collect())
    assert [x[:1] + x[2:] for x in loops] == [
        (6, 6, "For", "i < xs.length", True, False), (7, 7, "While", "a > 0", False, False), (8, 8, "For", "j < g(h(2))", False, True), (9, 9, "DoWhile", "n < 3", False, False),
        (9, 9, "For", "", False, False), (9, 9, "While", "t(u(v))", False, False), (10, 10, "While", "m > 1", False, False), (10, 10, "DoWhile", "q", False, False)]
    from auditloom.operators.facts import within

    assert {r.stmt: r.s_line for r in within(f.statements, f.loops).where("line < 8").collect()} == {"for (uint i = 0; i < xs.length; i++) xs[i].transfer(1);": 6, "while (a > 0) a--;": 7}


def test_one_scan_and_one_exchange(spark):
    """Facts are read off one table of members: no plan reads the sources twice or deals its pieces again."""
    import re

    source = spark.createDataFrame([("a.sol", AUCTION)], "file string, content string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for x in ("classic-reentrancy", "source-unchecked-return", "simple-timestamp", "source-missing-access-control", "source-unchecked-overflow"):
            plan = scan.detected(Facts(source), scan.selected([x]))._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Scan ExistingRDD", plan)) == 1 and len(re.findall(r"\bExchange ", plan)) == 1, x
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_text_is_cut_once_and_its_version_read_once_a_file(spark):
    source = spark.createDataFrame([(f"{i}.sol", OVERLOADS) for i in range(3)], "file string, content string").localCheckpoint()
    plan = pieces(source)._jdf.queryExecution().executedPlan().toString().split("Generate ")
    assert len(plan) == 2 and "pragma" not in plan[0] and "pragma" in plan[1]  # below the generator
    assert "Filter" not in plan[1]  # such as infers that there are pieces, and cuts each text to know


def test_what_reads_facts_more_than_once_reads_tables(spark, tmp_path):
    spark.range(8).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("td_scan_integer_overflow", "td_scan_unchecked_arithmetic", "td_scan_loop_reentrancy", "td_scan_composite", "td_facts_modifiers"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("(?<=[{};])") <= (name == "td_scan_unchecked_arithmetic"), name  # there the contract's own pieces
    for name in ("td_scan_time_vulnerabilities", "td_scan_gas_limit_dos"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("(?<=[{};])") == 1, name


OVERLOADS = """pragma solidity ^0.7.0;
contract A {
    function f(uint n) external { x = n; }
    function f(address[] memory a) external { for (uint i = 0; i < a.length; i++) { a[i].transfer(1); } }
    function f(address a) external { x = block.timestamp % 2 + block.timestamp * block.number; }
    function pickWinner() external { x = uint(keccak256(abi.encode(block.timestamp))) % block.number; }
}
"""


def test_loops_are_of_their_own_function_and_times_are_counted_by_place(spark):
    f = Facts(spark.createDataFrame([("o.sol", OVERLOADS)], "file string, content string"))
    assert [(r.line, r.function) for r in scan.detected(f, scan.selected(["source-gas-limit-dos"])).collect()] == [(4, "f")]
    times = scan.detected(f, scan.selected(["source-time-vulnerabilities"]))
    assert sorted((r.line, r.finding_type, r.severity, r.confidence) for r in times.collect()) == [(6, "block-number-randomness-source", "Medium", "High"), (6, "timestamp-randomness-source", "High", "High")]
    over = spark.createDataFrame([("u.sol", OVERLOADS.replace("{ x = block", "{ return block"))], "file string, content string")
    assert sorted((r.line, r.finding_type) for r in scan.detected(Facts(over), scan.selected(["source-time-vulnerabilities"])).collect())[:2] == [(5, "timestamp-source"), (5, "timestamp-source")]


def test_groups_by_the_best_of_three_strategies(spark):
    """Against the plain loop over findings, groups, members and strategies."""
    r = random.Random(9)
    vocabulary = ["reenter", "balance", "unchecked", "transfer", "missing", "modifier", "overflow", "timestamp"]
    kinds = ["reentrancy", "recursive_call", "owner-change", "permission-x", "other", "odd", None]
    rows = [(f, i, r.choice([None, *range(0, 900, 3)]), r.choice(kinds) if r.random() < 0.5 else None, " ".join(r.sample(vocabulary, r.randrange(0, 5))) or None) for f in "abc" for i in range(60)]
    rows += [("d", i, None, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "f string, o long, line long, kind string, said string")
    expand = {k: set(spark.range(1).select(correlate.expanded(F.lit(k)).alias("x")).first().x) for k in kinds if k}

    def location(a, b):
        return 1 - abs(a[2] - b[2]) / 10 if a[2] is not None and b[2] is not None and abs(a[2] - b[2]) < 10 else 0.0

    def pattern(a, b):
        if a[3] is None or b[3] is None:
            return 0.0
        return 1.0 if a[3] == b[3] else len(expand[a[3]] & expand[b[3]]) / len(expand[a[3]] | expand[b[3]])

    def semantic(a, b):
        x, y = (set((t[4] or "").split()) for t in (a, b))
        j = len(x & y) / len(x | y) if x | y else 0.0
        return round(0.7 * j, 6) if j >= 0.3 else 0.0

    want = {}
    for f in "abcd":
        groups = []
        for a in (x for x in rows if x[0] == f):
            best, at, how = 0.0, None, None
            for g in groups:
                score, name = 0.0, None
                for s, strategy in ((location, "location"), (pattern, "pattern"), (semantic, "semantic")):
                    if (v := max(s(a, b) for b in g)) > score:
                        score, name = v, strategy
                if score > best and score >= 0.5:
                    best, at, how = score, g, name
            if at is None:
                groups.append(at := [])
            at.append(a)
            want[f, a[1]] = (at[0][1], round(best, 6), how)
    got = {(x.f, x.o): (x.group, round(x.score, 6), x.strategy) for x in correlate.grouped_by_all(df, "f", "o", "line", "kind", "said").collect()}
    assert got == want
    assert {h for *_, h in want.values()} == {None, "location", "pattern", "semantic"}
    summed = {x.strategy: x.findings for x in correlate.by_strategy(correlate.grouped_by_all(df, "f", "o", "line", "kind", "said")).collect()}
    assert summed == {h: sum(x[2] == h for x in want.values()) for h in ("location", "pattern", "semantic")}


def test_components(spark):
    r = random.Random(2)
    edges = [("x", i, i + 1) for i in range(200)] + [("y", r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [("y", 1, 1)]
    got = {(x.g, x.node): x.component for x in graph.components(spark.createDataFrame(edges, "g string, a long, b long"), ["g"]).collect()}
    top = {(g, n): n for g, a, b in edges if a != b for n in (a, b)}
    for _ in range(300):
        for g, a, b in edges:
            if a != b:
                top[g, a] = top[g, b] = min(top[g, a], top[g, b])
    assert got == top


def test_pairs_come_from_classes_in_bounded_blocks(spark, monkeypatch):
    """Members of one text or line form blocks of a few; a pair comes once, by its best strategy, whatever side finds it."""
    r = random.Random(4)
    said = ("alpha beta gamma delta", "alpha beta gamma delta epsilon", "alpha beta", "tiny", None, "a b")
    rows = [(r.choice("pq") if i % 19 else None, i, r.choice((None, *range(0, 40, 3))), r.choice(said)) for i in range(240)]
    df = spark.createDataFrame(rows, "f string, o long, line long, said string")
    monkeypatch.setattr(correlate, "SIDE", 3)
    monkeypatch.setattr(correlate, "DEALT", 100)
    sets = [None if t is None else {w for w in t.split() if len(w) > 3} for *_, t in rows]
    want, like = set(), set()
    for a, (f, i, x, _) in enumerate(rows):
        for b, (g, j, y, _) in enumerate(rows):
            if i < j and f == g and f is not None:
                near = 1 - abs(x - y) / 10 if x is not None and y is not None and abs(x - y) < 10 else 0.0
                both = (sets[a] or set()) | (sets[b] or set())
                share = len((sets[a] or set()) & (sets[b] or set())) / len(both) if both else 0.0
                words = round(0.7 * share, 6) if share >= 0.3 else 0.0
                if words:
                    like.add((f, i, j, words))
                if max(near, words) >= 0.5:
                    want.add((f, i, j, round(max(near, words), 6), "location" if near >= words else "semantic"))
    got = [(x.f, x.a, x.b, round(x.score, 6), x.strategy) for x in correlate.candidates(df, "f", "o", "line", "said").collect()]
    assert len(got) == len(want) and set(got) == want
    found = correlate.semantic(df, "f", "o", "said")
    assert {tuple(x) for x in found.collect()} == like and found.count() == len(like)
    assert found.rdd.getNumPartitions() >= len(like) // 100


def test_rollup_keeps_no_set_of_all_places(spark):
    """The first places of each set, equal ones once, without an aggregate that collects all of them."""
    r = random.Random(5)
    rows = [(f"f{r.randrange(4)}", r.randrange(30), r.choice(("Low", "High", None)), r.choice("ab"), r.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "file string, line long, severity string, category string, score double")
    rolled = findings.rolled_up(df, "severity", "category", "file")
    want = {}
    for f, line, s, c, _ in rows:
        for key in (("severity", s), ("category", c), ("file", f), ("all", "")):
            want.setdefault(key, []).append(f"{f}:{line}")
    assert {(x.dimension, x.value): (x.findings, x["first"]) for x in rolled.collect()} == {k: (len(v), sorted(set(v))[:3]) for k, v in want.items()}
    assert "collect_set" not in rolled._jdf.queryExecution().optimizedPlan().toString()
