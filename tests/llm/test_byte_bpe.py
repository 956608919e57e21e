import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import byte_bpe as B

RANKS = B.read_ranks(B.default_ranks())
REAL = tiktoken.Encoding("real", pat_str=B.default_pattern(), mergeable_ranks=RANKS, special_tokens={})
ODD = ["", "a", " ", "it's John's they'll I'D", "<|endoftext|> x", "naïve café İstanbul ǅ", "日本語 テキスト 123½", "\x1c\x1d\x1e\x1f\x85᠎​﻿ x", "tab\t\tnew \n\r\n line  ", "!" * 5000, "ab" * 9000, "a" * 20000, " " * 3000 + "x", "🙂👩‍👩‍👧 ok", "\x00\x01"]


@pytest.fixture(scope="module")
def bpe():
    return B.Bpe(RANKS)


def ids_of(bpe, text):
    return np.frombuffer(bpe.packed(text, B.regex.compile(B.default_pattern()).finditer), "<u4").tolist()


def merged(piece, ranks):
    """Merges by rank, the plain way."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_as_the_library_on_odd_texts(bpe):
    for t in ODD:
        assert ids_of(bpe, t) == REAL.encode_ordinary(t), t[:40]
        assert B.decode(bpe.packed(t, B.regex.compile(B.default_pattern()).finditer), bpe.bytes_of) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("  \n'aeiounst12.,é")))
def test_as_the_library(bpe, text):
    assert ids_of(bpe, text) == REAL.encode_ordinary(text)


def test_every_code_point(bpe):
    """The split depends on letters, numbers and white space: both libraries agree on each code point of the planes in use."""
    for at in [*range(0, 0x33800, 1024), 0xE0000]:
        text = "".join(f"x{chr(c)}x1{chr(c)}1  {chr(c)}" for c in range(at, at + 1024) if not 0xD800 <= c < 0xE000)
        if ids_of(bpe, text) != REAL.encode_ordinary(text):
            for c in range(at, at + 1024):
                t = f"x{chr(c)}x1{chr(c)}1  {chr(c)}"
                assert ids_of(bpe, t) == REAL.encode_ordinary(t), hex(c)


@pytest.mark.parametrize("seed", range(6))
def test_small_vocabularies(seed):
    """Vocabularies of random merges over few letters, where longest matches are often wrong."""
    r = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    corpus = ["".join(r.choice("aab") for _ in range(60)).encode() for _ in range(20)]
    while len(ranks) < 300:
        parts = [merged_tokens(c, ranks) for c in corpus]
        pairs = [a + b for p in parts for a, b in zip(p, p[1:]) if a + b not in ranks]
        if not pairs:
            break
        ranks[r.choice(pairs)] = len(ranks)
    bpe = B.Bpe(ranks)
    for _ in range(300):
        piece = "".join(r.choice("aabc") for _ in range(r.randrange(1, 80))).encode()
        assert [bpe.bytes_of[i] for i in bpe.encode(piece)] == [bpe.bytes_of[i] for i in merged(piece, ranks)] or piece in ranks


def merged_tokens(piece, ranks):
    names = {v: k for k, v in ranks.items()}
    return [names[i] for i in merged(piece, ranks)]


def test_vocabularies_that_are_not_bpe():
    with pytest.raises(ValueError, match="no token for the bytes"):
        B.Bpe({b"a": 0})
    with pytest.raises(ValueError, match="no merge of lower ranks"):
        B.Bpe({bytes([b]): b for b in range(256)} | {b"abc": 256})


def expected(rows):
    out = []
    for i, text in rows:
        ids = np.array(REAL.encode_ordinary(text or ""), "<u4").tobytes()
        out.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_on_whole_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted(map(tuple, B.op13_byte_bpe(spark, d).collect()), key=str) == expected(rows)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None), (None, "x y"), (1, "x y"), (1, "x y"), (2, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 ids", "2 bytes", "3 id").repartition(3)
    got = B.decoded(B.encoded(docs))
    assert got.columns == ["doc_id", "ids", "bytes"]
    assert sorted(((r.doc_id, bytes(r.bytes)) for r in got.collect()), key=str) == sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    assert B.encoded(docs.limit(0)).count() == 0
    odd = spark.sql("SELECT 'a' doc_id, cast(unhex('61FF') as string) text")
    assert B.decoded(B.encoded(odd)).first().bytes == "a�".encode()
