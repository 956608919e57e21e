import hashlib
import wave
import io
import zlib

import pytest
from pyarrow import fs

from auditloom.llm import media as M

TEXTS = [None, "", "a", "x" * 192, "é" * 500, "long " * 40000, "a", " " * 191, "\x00\xff"]


def expected(i, t):
    data = (t or "").encode()
    n = max(1, -(-len(data) // 192)) * 192
    x = data.ljust(n)
    m = M.wav(x)
    return (i, len(data), n, hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:]), len(m), hashlib.sha256(m).hexdigest(), M.feature(x))


@pytest.mark.parametrize("archive_bytes,split", [(1, 1 << 20), (1 << 20, 50), (1 << 20, 1 << 20)])
def test_round_trip(spark, tmp_path, archive_bytes, split):
    rows = [*enumerate(TEXTS), (None, "n"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 id", "2 media").repartition(2)
    M.stored_media(docs, folder=f"file://{tmp_path}/a", archive_bytes=archive_bytes)
    back = spark.read.format("media_archive").option("split_bytes", split).option("batch_bytes", 300).load(f"file://{tmp_path}/a")
    assert sorted((tuple(r) for r in M.media_features(back).collect()), key=str) == sorted((expected(i, t) for i, t in rows), key=str)


def test_standard_wave():
    with wave.open(io.BytesIO(M.wav(b"abc" * 64))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes(), w.readframes(192)) == (1, 1, 192, b"abc" * 64)


def test_empty(spark):
    assert M.stored_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_failing_member_is_read_again(spark, tmp_path, monkeypatch):
    M.stored_media(spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_id long, text string").coalesce(1), folder=f"file://{tmp_path}/a")
    reader = M.ArchiveReader(f"file://{tmp_path}/a", 1 << 20, 1 << 20)
    real, calls = M.member_bytes, []

    def flaky(store, path, info):
        calls.append(info.header_offset)
        if calls.count(info.header_offset) == 1 and len(calls) % 2:
            raise OSError("gone")
        return real(store, path, info)

    monkeypatch.setattr(M, "member_bytes", flaky)
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("id").to_pylist()]
    assert sorted(got) == list(range(5)) and len(calls) > 5
    file = next(iter(fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/a"))))
    assert file.path


def test_whole_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, M.op7_media(spark, d).collect())) == sorted(expected(i, t) for i, t in rows)
