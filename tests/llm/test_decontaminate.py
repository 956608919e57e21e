import hashlib
import re

import numpy as np
import pytest

from auditloom.llm import decontaminate as D
from auditloom.llm.decontaminate import contamination, decontaminated
from auditloom.llm.fm_index import FMIndex

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, bench, size=13):
    wins = {}
    for item, text in bench:
        w = W.findall(low(text))
        if w:
            for i in range(max(1, len(w) - size + 1)):
                wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    lens, out = {len(w) for w in wins}, []
    for doc, text in docs:
        w = W.findall(low(text))
        hit, items = set(), set()
        for i in range(len(w)):
            for n in lens:
                if (x := tuple(w[i : i + n])) in wins and len(x) == n:
                    hit.update(range(i, i + n))
                    items |= wins[x]
        ids = sorted(map(str, items))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_occurrence(seed):
    r = np.random.default_rng(seed)
    t = r.integers(1, 2 + seed, 400) if seed < 5 else np.ones(300, int)
    index = FMIndex(t, sample=8)
    patterns = [t[i : i + n] for n in (1, 2, 5, 13) for i in range(0, 380 if seed < 5 else 280, 37)] + [np.array([9, 1]), np.array([1, 9, 1])]
    low_, high = index.search(patterns)
    for p, a, b in zip(patterns, low_, high):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(t) - len(p) + 1) if (t[i : i + len(p)] == p).all()]


BENCH = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Short One!"), (3, " ".join(f"W{i}" for i in range(3, 16))), (4, None), (5, "..."), (6, "été à la plage " * 5), (10, "short one")]
DOCS = [
    (0, None), (1, ""), (2, "w1 " * 40), (3, "x " + ", ".join(f"w{i}" for i in range(20)) + " y"), (3, "x " + ", ".join(f"w{i}" for i in range(20)) + " y"), (4, "a short-ONE b" + " z" * 300),
    (5, "Été à la plage " * 9), (6, "p " * 5000 + " ".join(f"w{i}" for i in range(3, 16))), (7, "w0 w1"), (None, "short one"), (8, "...,,,"), (9, "short short one one short one"),
]


@pytest.mark.parametrize("shard_bytes", [10, 500, 1 << 20])
@pytest.mark.parametrize("block_bytes", [50, 1 << 20])
def test_same_as_brute_force(spark, shard_bytes, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' items", "1 id").repartition(2)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = contamination(docs, bench, shard_bytes=shard_bytes, block_bytes=block_bytes).drop("items", "spans").collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, BENCH)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert contamination(docs.limit(0), bench).count() == 0
    assert sorted(map(tuple, contamination(docs, bench.limit(0)).drop("items", "spans").collect()), key=str) == brute(DOCS, [])


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([*DOCS, (11, "Zwölf ä " * 30 + "short one" + " ö" * 99)], "doc_id long, text string").selectExpr("*", "0 n_chars", "1 spans", "2 id")
    rows = {r.doc_id: r for r in decontaminated(docs, spark.createDataFrame(BENCH, "item_id long, text string")).collect()}
    assert set(rows) == {0, 1, 2, 4, 5, 6, 7, 8, 11} and rows[11].text == "Zwölf ä " * 30 + " ö" * 99 and rows[11].n_chars == len(rows[11].text) and rows[11].spans == 1
    assert rows[0].text is None and rows[2].text == "w1 " * 40 and rows[4].text == "a  b" + " z" * 300


def test_whole_small_table(spark):
    from auditloom.llm.decontaminate import op1_decontaminate

    d = "/root/testdata/sf0.001"
    want = brute(*(map(tuple, spark.read.parquet(f"{d}/{t}.parquet").select(k, "text").collect()) for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))))
    assert sorted(map(tuple, op1_decontaminate(spark, d).collect()), key=str) == want


def test_long_texts_in_pieces(spark):
    """Pieces of a few words: windows and spans over their limits are found as in the whole text."""
    r = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{j}" if r.random() < 0.97 else "ü" for k in range(4) for j in range(20))) for i in range(20)] + [(99, "ß " + " ".join(f"w{i}" for i in range(20)) + " é")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    got = contamination(df, bench, piece_bytes=40)
    assert sorted(map(tuple, got.drop("items", "spans").collect()), key=str) == brute(docs, BENCH)
    assert [tuple(x) for x in got.where("doc_id = 99").first().spans] == [(2, 2 + len(BENCH[0][1]))]
    assert sorted(map(str, got.collect())) == sorted(map(str, contamination(df, bench).collect()))


def test_a_million_different_words():
    t = np.arange(1, (1 << 20) + 50)
    index = FMIndex(np.concatenate([t, t[:5]]), sample=64)
    low_, high = index.search([t[:5], t[-3:], t[7:20]])
    assert (high - low_).tolist() == [2, 1, 1] and sorted(index.locate(np.arange(low_[0], high[0]))) == [0, len(t)]


def test_many_spans_of_a_long_text_take_seconds():
    """Code points are counted once, not from the text's beginning for each span."""
    import time

    text = ("é wörd " * 100_000).encode()
    shard = D.Shard([b"x", text])
    began = time.time()
    spans = [shard.span(1, w, w + 1) for w in range(0, 199_000)]
    assert time.time() - began < 5 and spans[1] == (2, 8) and spans[2] == (7, 13)
    assert all(text.decode()[a:b] in ("é wörd", "wörd é") for a, b in spans[:50] + spans[-50:])
