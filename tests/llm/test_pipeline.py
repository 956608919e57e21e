import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from auditloom.llm import mix, wavelet_tokens
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute_components, brute_fp

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows of documents, then of each stage."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for i, (_, f) in enumerate(P.STAGES):
        out.append(docs)
        f(spark, docs, D).write.parquet(at := str(tmp_path_factory.mktemp("p") / str(i)))
        docs = spark.read.parquet(at)
    return [*out, docs]


def test_columns_stay(kept):
    assert all(d.columns == kept[0].columns for d in kept[:-1])


def test_each_stage_does_its_work(spark, kept):
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in kept]
    text = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]
    assert all(any(map(str.isalpha, text[0][i])) for i in ids[1]) and len(ids[1]) > 0.97 * len(ids[0])
    fps = [(i, brute_fp(text[1][i])) for i in ids[1]]
    assert ids[2] == sorted(set(brute_components(fps)))
    bench = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute(list(text[2].items()), bench)
    assert ids[3] == sorted(r[0] for r in judged if not r[-1])
    assert ids[4] == ids[3] == ids[5]
    whole = [r[0] for r in judged if not r[2]]
    assert all(text[3][i] == text[2][i] for i in whole)
    again = brute(list(text[3].items()), bench)
    assert sum(r[2] for r in again) <= sum(r[2] for r in judged if not r[-1])


def test_tokens_follow_the_mixture(spark, kept):
    order = [(r.doc_id, r.text) for r in mix.mixed(kept[4], name="at").orderBy("at").collect()]
    t, at, want = Tokenizer.from_file(wavelet_tokens.default_tokenizer()), 0, []
    for i, text in order:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, kept[5].collect())) == sorted(want)


def test_edges_of_the_table(spark):
    for rows in ([], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "the cat sat", "en", "a", 11)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, f in P.STAGES:
            docs = f(spark, docs, D)
        assert docs.count() == (1 if rows else 0)
