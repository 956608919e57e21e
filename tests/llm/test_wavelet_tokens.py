import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from auditloom.llm import wavelet_tokens as W
from auditloom.llm.tokens import Encoder

ODD = ["", None, "a", "It's John's 'quoted' they'LL", "<|endoftext|> x <|startoftext|>y", "x<|endoftext", "naïve café ÀÉÎ ŒUVRE", "İstanbul ǅ ẞ", "日本語 テキスト 123", "é x y z", "1234 ½ x²", "a_b--c..!! ###x", "tab\tnew\nline\r\n", "\x0b\x0c\x1c\x85", "!" * 500, "a" * 3000, "🙂🙂 ok", "Ⱥb", "x" + "\x00" + "y", "ﬁ ﬂ", "µ ª º ¿qué?", "'", "''s"]
ODD += ["a" + "m" * 4095 + "b", "b" + "m" * 4095 + "a"]  # two pieces of one hash


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (700, 3), (5000, 49407), (3000, 100_000)])
def test_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint32)
    m, about = W.WaveletMatrix.from_bytes(W.WaveletMatrix.of(ids).to_bytes({"x": [1]}))
    assert (m.ids() == ids).all() and about["x"] == [1]
    at = np.arange(0, n, 7)
    assert (m.access(at) == ids[at]).all()
    for t in [*ids[:5].tolist(), top, 0, 1 << 20]:
        assert m.positions(t).tolist() == np.flatnonzero(ids == t).tolist() and m.count(t) == (ids == t).sum() and m.count(t, n // 2) == (ids[: n // 2] == t).sum()


def test_encoder_is_the_tokenizer(spark):
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    t = Tokenizer.from_file(W.default_tokenizer())
    ids, n = Encoder(open(W.default_tokenizer()).read()).encode(texts)
    for text, got, want in zip(texts, np.split(ids, np.cumsum(n)[:-1]), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, text[:80]


def expected(rows):
    t, at, out = Tokenizer.from_file(W.default_tokenizer()), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_tokens", [1, 200, 1 << 20])
def test_files_round_trip(spark, shard_tokens):
    rows = [(i * 7 % 23, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "none"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 part", "2 id", "3 start").repartition(3)
    got = W.read_tokens(W.token_files(docs, shard_tokens=shard_tokens))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert W.read_tokens(W.token_files(docs)).count() == 0


def test_whole_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, W.op9_wavelet_tokens(spark, d).collect()), key=str) == expected(rows)


def test_pieces_of_one_hash(spark):
    t = Tokenizer.from_file(W.default_tokenizer())
    e = Encoder(open(W.default_tokenizer()).read())
    for texts in (ODD[-2:], ODD[:-3:-1], ODD[-1:], ODD[-2:-1]):  # in one batch, the other way round, and known from before
        ids, n = e.encode(texts)
        for got, text in zip(np.split(ids, np.cumsum(n)[:-1]), texts, strict=True):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids


def test_leftovers_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    manifest = W.token_files(docs, folder=f"file://{tmp_path}/t")
    (tmp_path / "t" / "tokens-000000-00000-0.wm").write_bytes(b"left by a lost task")
    assert [r.id for r in W.read_tokens(manifest).orderBy("id").collect()] == [1, 2]
    assert len(list((tmp_path / "t").glob("*.wm"))) == manifest.count() + 1
