import hashlib
from collections import Counter

import pytest

from auditloom.llm import mix as M


def edf(units, period):
    names, done, out = sorted(units), Counter(), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // units[s]), s) for s in names if done[s] * period // units[s] <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


def placed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' src", "1 position_", "2 rank")
    return sorted(((r.position, r.doc_id, r.source) for r in M.mixed(docs, **options).collect()))


@pytest.mark.parametrize("units", [{"a": 1}, {"a": 3, "b": 4, "c": 3}, {"a": 70, "b": 20, "c": 7, "d": 3}])
def test_schedule_is_pfair(spark, units):
    period = sum(units.values())
    parts = spark.createDataFrame([(f"={s}", u) for s, u in units.items()], "src string, units long")
    got = [r.src[1:] for r in M.schedule(parts, period).orderBy("slot").collect()]
    assert got == edf(units, period)
    for t in range(period + 1):
        for s, u in units.items():
            assert abs(got[:t].count(s) * period - u * t) < period


def test_thousands_of_sources(spark):
    n, period = 5000, 20000
    units = {f"s{i:05d}": 1 for i in range(n)}
    for i in range(1, n, 3):
        units[f"s{i:05d}"] = 2
    units["s00000"] += period - sum(units.values())
    import heapq

    names, events, out, ready = sorted(units), {}, [], []
    for i, s in enumerate(names):
        for k in range(units[s]):
            events.setdefault(k * period // units[s], []).append((-(-(k + 1) * period // units[s]), i))
    for t in range(period):
        for e in events.get(t, []):
            heapq.heappush(ready, e)
        out.append(names[heapq.heappop(ready)[1]])
    parts = spark.createDataFrame(list(units.items()), "src string, units long")
    assert [r.src for r in M.schedule(parts, period).orderBy("slot").collect()] == out
    rows = [(i, f"s{i % n}") for i in range(7000)]
    assert [p for p, *_ in placed(spark, rows)] == list(range(7000))


def test_order_of_the_rows(spark):
    weights = {"a": 5, "b": 3, None: 2}
    rows = [(i, "a") for i in range(300)] + [(1000 + i, "b") for i in range(200)] + [(2000 + i, None) for i in range(47)]
    got = placed(spark, rows, weights=weights, block=2, period=10)
    assert [p for p, *_ in got] == list(range(547)) and sorted(x[1] for x in got) == sorted(x[0] for x in rows)
    period = 12  # four units for each source at least
    units = {"a": 6, "b": 3, None: 3}  # one each, then nine by weight: 4.5, 2.7, 1.8, so 1 + 4, 1 + 2 + 1, 1 + 1 + 1
    units = {"=a": 5, "=b": 4, "": 3}
    order = edf(units, period)
    queues = {("" if s is None else f"={s}"): sorted((i for i, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in weights}
    want, t = [], 0
    while any(queues.values()):
        s = order[t % period]
        want, queues[s], t = want + queues[s][:2], queues[s][2:], t + 1
    assert [i for _, i, _ in got] == want


def test_edges_of_the_table(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None), (2, ""), (3, "b")] * 3
    got = placed(spark, rows)
    assert [p for p, *_ in got] == list(range(len(rows))) and Counter(x[1:] for x in got) == Counter(rows)
    assert placed(spark, []) == []


def test_files_hold_the_mixture(spark, tmp_path):
    docs = spark.range(500).selectExpr("id doc_id", "concat('s', id % 3) source", "id place")
    docs = docs.unionByName(docs.where("id % 100 = 3") if "id" in docs.columns else docs.where("doc_id % 100 = 3"))  # rows alike in every column
    M.in_order(docs, block=1).write.parquet(str(tmp_path / "x"))
    read = []
    for f in sorted((tmp_path / "x").glob("part-*")):
        read += [r.doc_id for r in spark.read.parquet(str(f)).collect()]
    assert read == [r.doc_id for r in M.mixed(docs, block=1).orderBy("position").collect()]
