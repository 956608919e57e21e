import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from auditloom.llm import runs as R

CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def brute(words):
    """All runs: for each period the longest stretches, less those that a smaller period has whole."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= max(q, R.LEAST - q) and not any(s == i and e == j + q for s, e, _ in out):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest_row(doc_id, text):
    words = (text or "").encode().split()
    n, (g, r) = len(words), divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    row = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *row, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(docs):
    ids = R.Ids()
    words = np.array([ids[w] for d in docs for w in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    first = np.cumsum([0, *map(len, docs)])
    out = [[] for _ in docs]
    for s, e, q in zip(*(x.tolist() for x in R.runs_of(words, doc)), strict=True):
        d = int(doc[s])
        out[d].append((s - int(first[d]), e - int(first[d]), q))
    return out


def periodic(r):
    """Words with stretches that repeat, some of them within others."""
    out = []
    while len(out) < r.randrange(1, 200):
        root = [r.choice("abcdefgh"[: r.randrange(1, 9)]) for _ in range(r.randrange(1, 14))]
        out += (root * r.randrange(1, 9))[: r.randrange(1, 90)] + [f"w{r.randrange(500)}"] * r.randrange(2)
        if r.random() < 0.3:
            out += out[-r.randrange(1, 40) :]
    return out


def test_same_as_brute_force():
    r = random.Random(11)
    docs = [periodic(r) for _ in range(400)] + [[r.choice("ab") for _ in range(r.randrange(300))] for _ in range(60)]
    docs += [["a"] * n for n in (0, 1, 11, 12, 13, 64, 999)] + [["a", "b"] * 300 + ["a"], [], ["x"] * 11 + ["y"] * 12]
    thue, fibonacci = [0], ["b", "a"]
    for _ in range(9):
        thue = thue + [1 - x for x in thue]
    for _ in range(13):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    docs += [[str(x) for x in thue], list(fibonacci[-1]), list(fibonacci[-2] * 3)]
    got = found(docs)
    for d, g in zip(docs, got, strict=True):
        assert g == brute(d), d
    assert found([d for d in docs if d][::-1]) == [brute(d) for d in docs if d][::-1]


def test_grammar_gives_back_the_words():
    r = random.Random(3)
    docs = [periodic(r) for _ in range(50)]
    ids = R.Ids()
    words = np.array([ids[w] for d in docs for w in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    made, rest = R.repair(words.copy(), doc)
    assert rest["start"].tolist() == [0, *rest["end"].tolist()[:-1]] and rest["end"][-1] == len(words)
    text = {}
    for rule, s, m, e in zip(*(made[c].tolist() for c in ("rule", "start", "mid", "end")), strict=True):
        assert s < m < e
        assert text.setdefault(rule, (words[s:e].tolist(), m - s)) == (words[s:e].tolist(), m - s)
    uses = np.unique(made["rule"], return_counts=True)[1]
    assert (uses > 1).all()


def test_long_texts_take_seconds():
    r = random.Random(5)
    docs = [["a"] * 100_000, [f"w{i % 1000}" for i in range(100_000)], [r.choice("ab") for _ in range(50_000)], [f"w{r.randrange(300)}" for _ in range(200_000)]]
    got = found(docs)
    assert got[0] == [(0, 100_000, 1)] and got[1] == [(0, 100_000, 1000)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_and_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    df = R.op11_periodic_runs(spark, d)
    got = sorted(map(tuple, df.collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cur = con.execute(R.ORACLE_SQL["op11_periodic_runs"])
    at = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert sorted((tuple(x[i] for i in at) for x in cur.fetchall()), key=str) == got
    if sf == "sf0.001":  # a loop over all periods takes minutes on more
        assert got == sorted((digest_row(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()), key=str)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\x0b\x0c\r\n"), (None, "a b " * 10), (None, "a b " * 10), (5, "é\xa0 " * 13), (6, "x y\x1cz " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 runs", "2 id", "3 n_words", "4 w").repartition(3)
    got = {(r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in R.periodic_runs(docs).collect()}
    assert got == {(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (None, 20, ((0, 20, 2),), "a b"), (5, 13, ((0, 13, 1),), "é\xa0"), (6, 40, ((0, 40, 2),), "x y\x1cz")}
    assert R.periodic_runs(docs.limit(0)).count() == 0
    texts = [(k, t) for k in range(40) for t in (None, "", "one two three four five six seven")]
    assert R.with_periods(spark.createDataFrame(texts, "doc_id long, text string")).count() == len(texts)
