import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import prefix_trie as T


def brute(rows, again=True):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x for _, _, x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if again else 0
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids, under = {}, {p: [0, 0] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            under[p[:d]][0] += p not in kids
            under[p[:d]][1] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids.get(p, 0), *under[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000, 70_000])
def test_parentheses(n):
    r = random.Random(n)
    bits, depth = [], 0
    for _ in range(2 * n - 2):  # a random tree, at times deep
        left = 2 * n - 2 - len(bits)
        up = depth == 0 or (left > depth and r.random() < 0.5 + 0.4 * (len(bits) % 1000 < 300))
        bits.append(int(up))
        depth += 1 if up else -1
    bits = np.array([1, *bits, 0], np.uint8)
    stack, close = [], {}
    for i, b in enumerate(bits.tolist()):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    opens = np.flatnonzero(bits)
    tree = T.Parens(bits)
    assert tree.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
    assert tree.leaf_rank(np.array([len(bits)]))[0] == sum(bits[i] == 1 and bits[i + 1] == 0 for i in range(len(bits) - 1))


def test_range_min():
    r = np.random.default_rng(1)
    a = r.integers(0, 1000, 300)
    low = r.integers(0, 299, 500)
    high = low + 1 + r.integers(0, 300, 500) % (300 - low)
    assert T.range_min(a, low, high).tolist() == [a[x:y].min() for x, y in zip(low, high)]


def random_rows(r, n):
    rows = []
    for c in r.sample(range(3 * n), n):
        for turn in r.sample([None, *range(9)], r.randrange(1, 9)):
            rows.append((c, turn, r.choice(["user", "bot", None]), r.choice(["a", "é", "hello there", "", None])))
    base = [(t, r.choice(["user", "bot"]), f"turn {t}") for t in range(4)]
    rows += [(c, *t) for c in range(10_000, 10_000 + n) for t in base[: 4 if c % 3 else 3]]  # a third are copies
    return rows + r.sample(rows, 20) + [(None, 1, "user", "x")]


@pytest.mark.parametrize("shard_turns,seed", [(1 << 20, 1), (40, 2), (7, 3), (2, 4)])
def test_same_as_brute_force_at_any_shard_size(spark, shard_turns, seed):
    rows = random_rows(random.Random(seed), 60)
    p = T.paths(table(spark, rows).selectExpr("*", "1 path", "2 key", "3 shard", "4 t"))
    assert result(T.trie(T.rebuilt(p), shard_turns=shard_turns)) == brute(rows)
    assert result(T.trie(p, shard_turns=shard_turns)) == brute(rows, again=False)


def test_edges(spark):
    assert T.trie(T.paths(table(spark, []))).count() == 0
    long = [(7, i, "user", "x" * 1000) for i in range(90)] + [(7, 5000, "bot", "long " * 300_000), (9, None, None, None), (8, 1, None, None)]
    assert result(T.trie(T.rebuilt(T.paths(table(spark, long))), shard_turns=50)) == brute(long)
    # conversations that keep no turn: their base is missing and h is as large as they are
    bare = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    assert result(T.trie(T.rebuilt(T.paths(table(spark, bare))), shard_turns=3)) == brute(bare)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_and_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = T.op12_prefix_trie(spark, d)
    got = result(df)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    cur = con.execute(T.ORACLE_SQL["op12_prefix_trie"])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str) == got
    assert df.where(F.col("depth") == 0).count() == 1
