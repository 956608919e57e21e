import zlib

import numpy as np

from auditloom.llm import ftrl
from auditloom.llm import langid as L


def test_ngrams_match_a_plain_count():
    texts = ["Ab c1,  d", "", "ÀÉ", "x" * 70000, "日本 語", "!!", "𝐀b"]
    counts, letters = L.ngram_counts(texts)
    alone = [L.ngram_counts([t]) for t in texts]
    assert (counts == np.concatenate([c for c, _ in alone])).all() and letters.tolist() == [sum(x.isalpha() for x in t) for t in texts]
    assert counts[0].sum() == 3 * len("ab c d") and counts[1].sum() == 0
    assert (L.ngram_counts(["aB,C"])[0] == L.ngram_counts(["Ab  c"])[0]).all()


def test_elastic_net_and_temperature():
    r = np.random.default_rng(1)
    rows, ys = [], []
    for _ in range(600):
        y = int(r.random() < 0.5)
        at = np.array(sorted({y, *r.integers(2, 60, 6).tolist()}))
        rows.append((at, np.ones(len(at))))
        ys.append(y if r.random() < 0.9 else 1 - y)
    w = ftrl.Ftrl(60, 2, l1=2.0).fit(rows, ys)
    assert abs(w[:2]).min() > 3 * abs(w[2:]).mean() and (w == 0).any()
    s = ftrl.scores(w, rows)
    t = ftrl.temperature(s, np.array(ys))
    loss = lambda t: -np.log(ftrl.softmax(s / t)[np.arange(600), ys]).mean()
    assert loss(t) <= min(loss(t * 1.1), loss(t / 1.1)) + 1e-9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op2_language(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_edges_of_the_table(spark):
    rows = [(i, f"the cat {i}" if i % 2 else f"der hund {i}", "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "", None), (102, "12 34 !", "de"), (None, "the cat", "en"), (3, "the cat 3", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 score", "2 lang_pred", "'q' source")
    model = L.train(docs)
    got = L.identified(docs.drop("score", "lang_pred"), model, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows) and all(r.lang_pred == ("und" if not r.text or not any(map(str.isalpha, r.text)) else "en" if "cat" in r.text else "de") for r in got)
    kept = L.of_language(docs)
    assert kept.columns == docs.columns and kept.count() == 62
    none = docs.limit(0)
    assert L.of_language(none).count() == 0 and L.identified(none.drop("score", "lang_pred"), L.train(none), keep=("doc_id",)).count() == 0
    nothing = docs.withColumn("lang", docs.lang.substr(9, 0)).where("false")
    assert {r.lang_pred for r in L.identified(docs.drop("score", "lang_pred"), L.train(nothing), keep=("doc_id",)).collect()} == {"und"}
