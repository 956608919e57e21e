import random
import re

import numpy as np
import xxhash

from auditloom.llm import simhash as S

TEXTS = [None, "", "  \n ", "One two", "one TWO", "a b c", "A b\tc", "ÀB b c", "a b c d e f g h"] + ["x y z " * 50, "x y z " * 50 + "w"]


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return "0" * 16
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def brute_components(fps):
    """fps: (id, fingerprint); the least id reachable by links of 2 bits."""
    left, out = dict(enumerate(fps)), [None] * len(fps)
    while left:
        stack, group = [left.popitem()], []
        while stack:
            k, (i, f) = stack.pop()
            group.append((k, i))
            near = [x for x, (_, g) in left.items() if (int(f, 16) ^ int(g, 16)).bit_count() <= 2]
            stack += [(x, left.pop(x)) for x in near]
        least = min((i for _, i in group if i is not None), default=None)
        for k, _ in group:
            out[k] = least
    return out


def test_golay_tables():
    e = S.error_table()
    assert (S.syndrome(np.where(e >= 0, e, 0)) == np.where(e >= 0, np.arange(2048)[:, None], 0)).all()
    assert set((e >= 0).sum(axis=1).tolist()) == {1, 6}
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 23, 3000)
    b = a ^ (1 << r.integers(0, 23, 3000)) ^ (1 << r.integers(0, 23, 3000))
    for x, y in zip(S.codewords(a, e).tolist(), S.codewords(b, e).tolist()):
        assert {*x} - {-1} & {*y} - {-1}


def test_fingerprints(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id: r.fingerprint for r in S.near_duplicates(docs).collect()} == {i: brute_fp(t) for i, t in enumerate(TEXTS)}


def linked(spark, fps, bucket):
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node: r.component for r in S.components(S.links(nodes, bucket)).collect()}
    groups = {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(found.get(s, s), set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_links_lose_nothing(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(30):
            fps.add(f)
            for _ in range(r.choice([1, 2, 2, 2, 3])):
                f ^= 1 << r.randrange(64)
    fps = sorted(fps)
    want = brute_components([(f, f"{f:016x}") for f in fps])
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(f)
    for bucket in (64, 1):  # 1: all through the path of large buckets
        assert linked(spark, fps, bucket) == sorted(map(sorted, groups.values()))


def test_edges_of_the_table(spark):
    rows = [(5, "a b c"), (3, "A b c"), (None, "a b c"), (None, "q"), (7, None), (9, ""), (9, ""), (4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 component_id", "3 id")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3), (4, 4), (5, 3), (7, 7), (9, 7), (9, 7), (None, None), (None, 3)], key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 7), (True, 0)]


def test_whole_small_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    fps = [(i, brute_fp(t)) for i, t in docs]
    want = sorted((i, f, c) for (i, f), c in zip(fps, brute_components(fps)))
    assert sorted(map(tuple, S.op6_simhash(spark, d).collect())) == want
