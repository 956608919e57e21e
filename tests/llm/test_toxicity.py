import numpy as np

from auditloom.llm import toxicity as X


def test_features_don_t_depend_on_the_batch():
    texts = ["A bc, dé bc", "", "x", "longword " * 3, "..."]
    got = X.features(texts)
    assert [g.tolist() for g in got] == [X.features([t])[0].tolist() for t in texts] and X.features([]) == []
    assert len(got[0]) == 3 and len(got[1]) == len(got[4]) == 0 and len(got[3]) == 1 + len(X.STEMS)


def test_chain_feeds_earlier_categories():
    r = np.random.default_rng(2)
    at, ys = [], []
    for _ in range(800):
        a, b = r.random(2) < 0.4
        at.append(np.unique(np.concatenate([[1] if a else [], [2] if b else [], r.integers(10, 500, 8)]).astype(int)))
        ys.append((a, a != b))  # the second depends on the first
    chain = X.fit_chain(at, np.array(ys, int), ["a", "x"], epochs=8)
    assert abs(chain.weights[1][X.DIMS]).max() > 0.05  # weight of the first category's probability
    assert ((chain.predict(at)[:, 0] > 0.5) == np.array(ys)[:, 0]).mean() > 0.95


def test_accuracy_on_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    chain = X.train(docs, labels.where("doc_id % 3 > 0"), categories=X.CATEGORIES)
    got = X.classified(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id").select("is_toxic", "toxic").collect()
    hit = sum(r.is_toxic and r.toxic == 1 for r in got)
    print(hit, sum(r.toxic for r in got), sum(r.is_toxic for r in got))
    assert hit / sum(r.toxic for r in got) > 0.8 and hit / max(1, sum(r.is_toxic for r in got)) > 0.9


def test_edges_of_the_table(spark):
    rows = [(i, "you idiot " + str(i) if i % 3 == 0 else "kind words " + str(i)) for i in range(90)] + [(None, "idiot"), (500, None), (501, ""), (3, "you idiot 3"), (502, "so kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 toxic", "2 id", "3 p_toxic")
    labels = spark.createDataFrame([(i, 1 if i % 2 else None, int(i % 3 == 0)) for i in range(90)] + [(999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = X.classified(docs, X.train(docs, labels, categories=X.CATEGORIES)).collect()
    assert len(got) == len(rows) and all(r.is_toxic == (r.doc_id < 90 and r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 90)
    assert X.classified(docs.limit(0), X.train(docs, labels.limit(0), categories=X.CATEGORIES)).count() == 0
    assert X.classified(docs, X.train(docs.limit(0), labels, categories=X.CATEGORIES)).count() == len(rows)
