import random

from pyspark.sql import functions as F

from auditloom.operators import defuse, ir, reentrancy

SCHEMA = "contract string, func string, block long, pos long, op string, key string, name string, message string, target string, value string, operands array<string>"


def instr(spark, rows):
    """rows: (func, block, op, {...})."""
    out = [("C", f, b, i, op, x.get("key"), x.get("name"), x.get("message"), x.get("target"), x.get("value"), x.get("operands")) for i, (f, b, op, x) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def functions(spark, *names):
    return spark.createDataFrame([("C", n, "public", []) for n in names], "contract string, func string, visibility string, modifiers array<string>")


def test_senders_and_constants(spark):
    i = instr(spark, [("f", 0, "MsgSender", {"value": "a"}), ("f", 0, "Cast", {"value": "b", "operands": ["a"]}), ("f", 0, "Truncate", {"value": "c", "operands": ["b"]}), ("f", 0, "Add", {"value": "d", "operands": ["c", "const:1"]}),
                      ("g", 0, "Cast", {"value": "b", "operands": ["a"]}), ("g", 0, "Add", {"value": "k", "operands": ["const:1", "const:2"]}), ("g", 0, "Mul", {"value": "m", "operands": ["k", "k"]}), ("g", 0, "Sub", {"value": "n", "operands": ["m", "param:0"]}), ("g", 0, "Add", {"value": "o", "operands": ["m", "k"]})])
    assert {(r.func, r.value) for r in defuse.senders(i).collect()} == {("f", "a"), ("f", "b"), ("f", "c")}
    assert {(r.func, r.value) for r in defuse.constants(i).collect()} == {("g", "k"), ("g", "m"), ("g", "o")}
    assert defuse.senders(i.limit(0)).count() == 0 and defuse.constants(i.limit(0)).count() == 0


def test_access_control_looks_at_operands(spark):
    me, store = ("MsgSender", {"value": "s"}), {"value": None}
    rows = [(f, 0, *x) for f, xs in {
        "mint": [("StorageStore", store)],  # no check
        "credit": [me, ("MappingStore", {"operands": ["s", "param:0"]})],  # the caller's own entry
        "setRate": [me, ("MappingStore", {"operands": ["param:0", "s"]})],  # someone's entry
        "guarded": [me, ("Eq", {"value": "e", "operands": ["s", "o"]}), ("StorageStore", store)],
        "lookup": [me, ("Cast", {"value": "t", "operands": ["s"]}), ("MappingLoad", {"value": "r", "operands": ["t"]}), ("StorageStore", store)],
        "other": [me, ("MappingLoad", {"value": "r", "operands": ["param:1"]}), ("StorageStore", store)],
        "origin": [("TxOrigin", {"value": "o"}), ("Require", {"operands": ["x"], "message": ""}), ("StorageStore", store)],
        "inner": [("Call", {"target": "Internal", "name": "x"})],
        "outer": [("Call", {"target": "External", "name": "x"})],
    }.items() for x in xs]
    got = {(r.func, r.finding_type, r.severity, r.confidence) for r in defuse.access_control(instr(spark, rows), functions(spark, *{r[0] for r in rows})).collect()}
    missing = lambda f, s: (f, "missing-access-control", s, "Medium")
    assert got == {missing("mint", "High"), missing("setRate", "Low"), missing("other", "Low"), missing("outer", "High"), ("origin", "weak-access-control-tx-origin", "Medium", "High")}


def test_unchecked_returns(spark):
    call = lambda v: ("Call", {"target": "External", "name": "send", "value": v})
    rows = [(f, b, *x) for f, xs in {
        "bare": [(0, call("a"))],
        "said": [(0, call("a")), (0, ("Require", {"operands": ["z"], "message": "transfer FAILED"}))],
        "far": [(0, call("a")), (1, ("Require", {"operands": ["a"], "message": ""}))],  # another block: not looked at
        "late": [(0, call("a")), (0, call("b")), (0, ("Require", {"operands": ["a"], "message": "failed"}))],  # after the next call: it is b's
        "condition": [(0, call("a")), (0, ("Require", {"operands": ["a"], "message": ""}))],
        "joined": [(0, call("a")), (0, ("And", {"value": "j", "operands": ["a", "q"]})), (0, ("Require", {"operands": ["j"], "message": ""}))],
        "equal": [(0, call("a")), (3, ("Ne", {"value": "j", "operands": ["q", "a"]}))],
        "less": [(0, call("a")), (3, ("Lt", {"value": "j", "operands": ["q", "a"]}))],
    }.items() for b, x in xs]
    assert sorted((r.func, r.name) for r in defuse.unchecked_returns(instr(spark, rows)).collect()) == [("bare", "send"), ("far", "send"), ("late", "send"), ("less", "send")]


def test_overflows(spark):
    rows = [("f", 0, "StorageLoad", {"value": "a"}), ("f", 0, "Add", {"value": "b", "operands": ["a", "const:1"]}), ("f", 0, "Mul", {"value": "c", "operands": ["b", "const:1"]}), ("f", 1, "Mul", {"value": "d", "operands": ["const:1", "param:0"]}), ("f", 1, "Sub", {"value": "e", "operands": ["a", "a"]}), ("f", 1, "Div", {"value": "g", "operands": ["a", "a"]})]
    looped = spark.createDataFrame([("C", "f", 1)], "contract string, func string, block long")
    assert sorted((r.op, r.severity, r.confidence) for r in defuse.overflows(instr(spark, rows), looped).collect()) == [("Add", "Medium", "Medium"), ("Mul", "High", "High"), ("Sub", "High", "High")]


def test_closure_and_cross_function(spark):
    e = spark.createDataFrame([("C", a, b, p, False) for a, b, p in [("a", "b", 1), ("b", "c", 2), ("a", "x", 5), ("x", "c", 6), ("c", "a", 9), ("d", "d", 0)]] + [("D", "a", "c", 1, False), ("C", "a", "out", 0, True)], "contract string, caller string, callee string, pos long, is_external boolean")
    edges = e.where("not is_external").select("contract", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    got = {(r.contract, r.start, r.node): (r.depth, r.path) for r in reentrancy.closure(edges, ["contract"]).collect()}
    assert got["C", "a", "c"] == (2, ["a", "b", "c"]) and got["D", "a", "c"] == (1, ["a", "c"]) and got["C", "d", "d"] == (0, ["d"]) and ("C", "a", "d") not in got
    rows = [("a", 0, "StorageLoad", {}), ("a", 0, "Call", {"target": "Internal", "name": "b"}), ("a", 0, "DelegateCall", {}), ("b", 0, "StorageStore", {"key": "k"}), ("c", 0, "MappingStore", {"key": "m"}), ("a", 0, "Call", {"target": "Internal", "name": "x"}), ("tokensReceived", 0, "StorageStore", {"key": "z"})]
    cross = {r.other: (r.path, r.keys, r.is_hook) for r in reentrancy.cross_function(instr(spark, rows), e).collect() if r.func == "a"}
    assert cross == {"c": (["a", "b", "c"], ["m"], False)}  # b is called before the call outside only


def search(successors):
    """The plain loop: paths taken up first in, first out."""
    queue, out, taken = [[min(successors)]], [], 0
    while queue and taken < reentrancy.MOST:
        path, taken = queue.pop(0), taken + 1
        if path[-1] not in successors:
            continue
        if not successors[path[-1]]:
            out.append(path)
        for x in successors[path[-1]]:
            if x not in path or len(path) < reentrancy.AGAIN:
                if len(path) < reentrancy.LONGEST:
                    queue.append([*path, x])
                else:
                    out.append(path)
    return out


def test_paths_are_those_of_a_plain_loop(spark):
    r = random.Random(4)
    flows = {"diamond": {0: [1, 2], 1: [3], 2: [3], 3: []}, "loop": {0: [1], 1: [0, 2], 2: []}, "seven": {0: [*range(1, 8)], **{i: [8] for i in range(1, 8)}, 8: [*range(9, 16)], **{i: [16] for i in range(9, 16)}, 16: [17, 18], 17: [], 18: [19], 19: []}, "long": {i: [i + 1, i + 2] for i in range(40)}, "one": {5: []}, "twice": {0: [1, 1], 1: []}, "line": {i: [i + 1] for i in range(30)}}
    flows |= {f"r{k}": {i: r.sample(range(12), r.randrange(0, 4)) for i in range(12)} for k in range(20)}
    df = spark.createDataFrame([("C", f, b, n) for f, s in flows.items() for b, n in s.items()], "contract string, func string, block long, next array<long>")
    got = {}
    for x in reentrancy.explored(df, ir.BY).orderBy("func", "n").collect():
        got.setdefault(x.func, []).append(x.path)
    assert got == {f: p for f, s in flows.items() if (p := search(s))}


def test_where_paths_part(spark):
    paths = spark.createDataFrame([("C", "f", 1, [0, 1, 3]), ("C", "f", 2, [0, 2, 3]), ("C", "f", 3, [0, 2, 3, 4])], "contract string, func string, n long, path array<long>")
    i = instr(spark, [("f", 1, "Call", {"target": "External"}), ("f", 2, "StorageStore", {}), ("f", 3, "StorageStore", {}), ("f", 4, "ArrayStore", {}), ("f", 9, "StorageStore", {})])
    assert sorted((r.call, r.write, r.parts_at) for r in reentrancy.conditional(paths, i).collect()) == [(0, 1, 0), (0, 2, None), (0, 3, 0)]


def test_all_kinds_and_the_guard(spark):
    call, store = ("Call", {"target": "External", "name": "x"}), ("StorageStore", {"key": "k"})
    body = lambda f: [(f, 0, *call), (f, 1, *store), (f, 2, *store)]
    guarded = [("g", 0, *store), *body("g"), ("g", 0, "Call", {"target": "External", "name": "safeTransfer"})]
    i = instr(spark, [*body("f"), *guarded])
    fn = spark.createDataFrame([("C", "f", "public", []), ("C", "g", "public", ["nonReentrant"])], "contract string, func string, visibility string, modifiers array<string>")
    e = spark.createDataFrame([("C", "f", "g", 7, False)], "contract string, caller string, callee string, pos long, is_external boolean")
    s = spark.createDataFrame([("C", x, b, n) for x in "fg" for b, n in [(0, [0, 1]), (1, [2]), (2, [])]], "contract string, func string, block long, next array<long>")
    got = sorted(tuple(r)[1:] for r in reentrancy.reentrancy(i, fn, e, s).collect())
    assert got == [("f", "conditional-reentrancy", 0, "1"), ("f", "conditional-reentrancy", 0, "2"), ("f", "cross-function-reentrancy", 0, "g"), ("f", "loop-reentrancy", 0, "1"), ("f", "reentrancy", 0, "1"), ("f", "reentrancy", 0, "2"), ("f", "reentrancy-pattern", 0, "1")]


def test_ordering(spark):
    call, store, check = ("Call", {"target": "External"}), ("StorageStore", {}), ("Require", {})
    i = instr(spark, [("g", 0, *store), ("f", 0, *check), ("f", 0, *call), ("f", 0, *store), ("f", 1, *store), ("f", 1, *call), ("h", 0, *call), ("h", 0, "Call", {"target": "Internal"})])
    got = sorted((r.func, r.call, r.place, r.last_check, r.last_write, r.next_write, r.gap, r.verdict) for r in ir.ordering(i).collect())
    assert got == [("f", 2, 1, 1, None, 3, 1, "write-after-call"), ("f", 5, 4, 1, 4, None, None, "effects-first"), ("h", 6, 6, None, None, None, None, "no-writes")]


def test_what_each_focus_looks_at(spark):
    i = instr(spark, [("f", 0, "Call", {"target": "External", "name": "send", "value": "a"}), ("f", 0, "Require", {"operands": ["a"], "message": "sent"}), ("f", 1, "Call", {"target": "External", "value": "b"}), ("f", 1, "CheckedMul", {"operands": ["x", "const:2"], "value": "c"}), ("f", 1, "StorageStore", {"key": "k"}), ("f", 1, "Selfdestruct", {})])
    got = sorted((r.focus, r.kind, r.block, r.pos, r.text) for r in defuse.found_in_focus(i).collect())
    assert got == [("access", "check", 0, 1, "require(a): sent"), ("access", "sensitive", 0, 0, "Value transfer to send"), ("access", "sensitive", 1, 4, "Storage modification"), ("access", "sensitive", 1, 5, "Self destruct"), ("arithmetic", "checked", 1, 3, "checked_mul(x, const:2)"),
                   ("reentrancy", "call", 0, 0, "Call send"), ("reentrancy", "call", 1, 2, "Call"), ("reentrancy", "write", 1, 4, "StorageStore k"), ("returns", "unused", 1, 2, ""), ("returns", "used", 0, 0, "send")]


def test_prices_by_checks_and_operands(spark):
    call = lambda name, target="External": ("Call", {"name": name, "target": target})
    check = lambda message: ("Require", {"message": message})
    rows = [(f, 0, *x) for f, xs in {
        "one": [("Add", {}), call("priceFeed"), call("x", "External")],
        "built": [call("oracle", "Builtin")],
        "own": [call("chainlinkRead", "Internal"), call("myOracle", "Internal"), call("aggregator", "Library")],
        "aged": [call("oracle"), call("feed"), check("price too OLD: timestamp")],
        "time": [call("oracle"), call("feed"), check("past its time")],  # speaks of time, but not of prices
        "safe": [check("price deviation out of range"), check("swap below minimum")],
        "sums": [*[("Mul", {})] * 3, ("Div", {"operands": ["v1", "const:2"]}), ("StorageLoad", {})],
        "maps": [*[("Mul", {})] * 4, ("MappingLoad", {})],
        "parts": [("Div", {"operands": ["a", b]}) for b in ("v1", "storage:total", "param:0", "const:3", None)],
        "none": [("Div", {}), ("Div", {"operands": []})],
    }.items() for x in xs]
    got = sorted(((r.func, r.finding_type, r.pos) for r in ir.price_findings(instr(spark, rows)).collect()), key=str)
    at = {}  # first instruction of each function
    for i, r in enumerate(rows):
        at.setdefault(r[0], i)
    want = [
        ("one", "single-oracle-dependency", at["one"] + 1), ("one", "no-oracle-freshness-check", at["one"] + 1), ("own", "no-oracle-freshness-check", at["own"] + 1), ("aged", "no-price-deviation-check", None), ("aged", "no-slippage-protection", None),
        ("time", "no-oracle-freshness-check", at["time"]), ("sums", "complex-price-calculation", at["sums"]), ("parts", "division-by-manipulable-value", at["parts"]), ("parts", "division-by-manipulable-value", at["parts"] + 1),
    ]
    assert got == sorted(want, key=str)


def test_listings_are_validated(spark):
    rows = [("fine", "function a:\n[0] Add\n[3] Call x y\n\nfunction b:\n[0] Add  \r\n"), ("fall", "function a:\n[4] Add\n[4] Add"), ("bare", "[0] Add\nfunction a:"), ("odd", "function a:\n[0] add"), ("twice", "function a:\n[0] Add\nfunction a:"),
            ("blank", "\n \n"), ("null", None), (None, "function a:"), ("huge", "function a:\n" + "\n".join(f"[{i}] Op{i % 3}" for i in range(20000)))]
    got = {r.file: (r.elements, r.instructions, r.rules, r.ok, r.error) for r in ir.validated(spark.createDataFrame(rows, "file string, text string")).collect()}
    assert got == {
        "fine": (2, 3, "Add=2,Call=1", True, None), "fall": (1, 2, "Add=2", False, "line 3: places that don't rise"), "bare": (1, 1, "Add=1", False, "line 1: an instruction before any function"), "odd": (1, 0, "", False, "line 2: neither a function nor an instruction"),
        "twice": (2, 1, "Add=1", False, "a function named twice"), "blank": (0, 0, "", False, "no functions"), "null": (0, 0, "", False, "no functions"), None: (1, 0, "", True, None), "huge": (1, 20000, "Op0=6667,Op1=6667,Op2=6666", True, None),
    }


def test_rounds_are_tables_and_are_not_sent_to_all(spark):
    """What is worked out after a search reads tables of its rounds: its plan has few joins, and no round's rows are broadcast."""
    from auditloom.operators import graph

    edges = spark.createDataFrame([("C", "f", i, i + 1) for i in range(14)] + [("C", "f", 3, 1)], "contract string, func string, src long, dst long")
    writes = spark.createDataFrame([("C", "f", 13), ("C", "f", 14)], "contract string, func string, block long")
    found = graph.loops(edges, ["contract", "func"])
    after = graph.writes_after(found, edges, writes, ["contract", "func"])
    assert [tuple(x) for x in after.collect()] == [("C", "f", 1, [13, 14])]
    assert [tuple(x) for x in graph.writes_after(found, edges, writes, ["contract", "func"], most=8).collect()] == []
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Join ") < 15  # one a round, not one for all before it in each
    plans = []

    def step(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    flow = spark.createDataFrame([("C", "f", i, [i + 1] if i < 5 else []) for i in range(6)], "contract string, func string, block long, next array<long>")
    assert [x.path for x in reentrancy.explored(flow, ["contract", "func"], step).collect()] == [[0, 1, 2, 3, 4, 5]]
    assert not any("Broadcast" in p for p in plans)
