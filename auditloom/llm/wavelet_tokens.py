"""Token-id output: one wavelet-matrix file for each shard of documents, read back without any other data."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table
from .tokens import Encoder
from .vectext import cuts

MAGIC = b"WMTOK1\n"
END_ID = 1
MANIFEST = "part long, seq long, n_tokens long, bytes long, path string"
WORDS = 8  # 64-bit words between two running counts


class Plane:
    """One bit-plane: words, and the ones before each block of 512 bits."""

    def __init__(self, words: np.ndarray, before: np.ndarray, zeros: int):
        self.words, self.before, self.zeros = words, before, zeros

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        words = np.concatenate([packed, np.zeros(-len(packed) % 64, np.uint8)]).view(np.uint64)
        ones = np.bitwise_count(words).reshape(-1, WORDS).sum(axis=1, dtype=np.int64)
        return cls(words, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32), len(bits) - int(ones.sum()))

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), bitorder="little", count=n).view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        block = i >> 9
        left = (i[:, None] & 511) - 64 * np.arange(WORDS)
        mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << np.clip(left, 0, 63).astype(np.uint64)) - np.uint64(1))
        at = np.minimum(block[:, None] * WORDS + np.arange(WORDS), max(0, len(self.words) - 1))
        inside = np.bitwise_count(self.words[at] & mask).sum(axis=1, dtype=np.int64) if len(self.words) else 0
        return self.before[block].astype(np.int64) + np.where(i & 511, inside, 0)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the bit's k-th occurrence, from 0 on."""
        before = self.before.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * 512 - before
        block = np.searchsorted(before, k, "right") - 1
        inside = np.unpackbits(self.words.reshape(-1, WORDS)[block].view(np.uint8), axis=1, bitorder="little") == bit
        return block * 512 + np.argmax(np.cumsum(inside, axis=1) == (k - before[block] + 1)[:, None], axis=1)


class WaveletMatrix:
    """n token ids as bit-planes from the highest bit down, each stably sorted by the planes above it."""

    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n = planes, n

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max(initial=0))
        s = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes = []
        for k in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (s >> k & 1).astype(bool)
            planes.append(Plane.of(bit))
            s = np.concatenate([s[~bit], s[bit]])
        return cls(planes, len(ids))

    def ids(self) -> np.ndarray:
        """All token ids, rebuilt from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, p in enumerate(reversed(self.planes)):
            bit, up = p.bits(self.n), np.empty_like(out)
            up[~bit] = out[: p.zeros]
            up[bit] = out[p.zeros :] | out.dtype.type(1 << k)
            out = up
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        i, c = np.asarray(i, np.int64), np.zeros(len(i), np.int64)
        for p in self.planes:
            bit, one = p.get(i), p.rank(i)
            c, i = c << 1 | bit, np.where(bit, p.zeros + one, i - one)
        return c

    def _range(self, token: int, i: int) -> tuple[int, int]:
        at = np.array([0, i])
        if token >> len(self.planes):
            return 0, 0
        for k, p in zip(range(len(self.planes) - 1, -1, -1), self.planes, strict=True):
            one = p.rank(at)
            at = p.zeros + one if token >> k & 1 else at - one
        return int(at[0]), int(at[1])

    def count(self, token: int, before: int | None = None) -> int:
        """Occurrences of a token before a position."""
        a, b = self._range(token, self.n if before is None else before)
        return b - a

    def positions(self, token: int) -> np.ndarray:
        """Positions of all occurrences of a token."""
        a, b = self._range(token, self.n)
        at = np.arange(a, b)
        for k, p in enumerate(reversed(self.planes)):
            at = p.select(at - p.zeros, 1) if token >> k & 1 else p.select(at, 0)
        return at

    def to_bytes(self, about: dict) -> bytes:
        """Magic, length and JSON of the directory, then each plane's words and counts, compressed."""
        z = zstandard.ZstdCompressor(level=1)
        parts = [z.compress(x.tobytes()) for p in self.planes for x in (p.words, p.before)]
        head = json.dumps(about | {"n": self.n, "zeros": [p.zeros for p in self.planes], "sizes": [len(x) for x in parts]}).encode()
        return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *parts])

    @classmethod
    def from_bytes(cls, file: bytes) -> tuple[WaveletMatrix, dict]:
        if file[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet-matrix token file")
        at = len(MAGIC) + 8
        size = int.from_bytes(file[at - 8 : at], "little")
        about = json.loads(file[at : at + size])
        at, parts, z = at + size, [], zstandard.ZstdDecompressor()
        for n in about["sizes"]:
            parts.append(z.decompress(file[at : at + n]))
            at += n
        pairs = zip(parts[::2], parts[1::2], about["zeros"], strict=True)
        return cls([Plane(np.frombuffer(w, np.uint64), np.frombuffer(b, np.uint32), zero) for w, b, zero in pairs], about["n"]), about


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(2)
def encoder_of(definition: str) -> Encoder:
    """A worker's encoder: the pieces it knows serve later tasks."""
    return Encoder(definition)


def bytes_of(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def token_files(docs: DataFrame, *, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, shard_tokens: int = 1 << 20, range_bytes: int = 32 << 20, total_bytes: int | None = None, folder: str | None = None) -> DataFrame:
    """Documents as wavelet-matrix files in a folder, in ascending order of order_col (id_col if not given). Returns their
    manifest (part, seq, n_tokens, bytes, path), which is kept beside them as the table `_manifest`.

    Rows are dealt out by ranges of the order, of about range_bytes of text each, and sorted within; each task cuts its
    rows into shards of about shard_tokens ids (one longer document is a shard of its own), END_ID after each document.
    Nulls come first in the order; rows that tie come by text. Null texts count as empty. The tokenizer's definition is
    read on the driver and broadcast (it doesn't grow with the data). Each shard is one file, which from_bytes() reads
    without any other. A file's name has its attempt in it, and the manifest holds those of the attempts that Spark
    committed: what a lost task leaves is not read. total_bytes: of all texts, where docs are dear to work out twice. folder: a URI that all executors reach; none: one in the shared folder.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encoder = encoder_of(definition.value)
        names, counts, held, tokens = [], [], [], 0
        store, root = fs.FileSystem.from_uri(folder)

        def shard() -> pa.RecordBatch:
            file = WaveletMatrix.of(np.concatenate(held)).to_bytes({"ids": names, "counts": counts})
            name = f"tokens-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.wm"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(file)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([tokens]), pa.array([len(file)]), pa.array([f"{folder}/{name}"])], ["part", "seq", "n_tokens", "bytes", "path"])

        for batch in batches:
            at = 0
            for to in cuts(batch.column("text"), 2 << 20):
                piece = batch.slice(at, to - at)
                ids, n = encoder.encode([x or "" for x in piece.column("text").to_pylist()])
                at = to
                ids = np.insert(ids, np.cumsum(n), END_ID)
                names += piece.column("id").to_pylist()
                counts += (n + 1).tolist()
                held.append(ids.astype(np.uint32))
                tokens += len(ids)
                if tokens >= shard_tokens:
                    yield shard()
                    names, counts, held, tokens, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    order = F.col(order_col or id_col)
    source = docs.select(order.alias("place"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if source.schema["id"].dataType.typeName() not in ("long", "integer", "short", "byte", "string"):
        raise TypeError("ids are integers or strings")
    total = bytes_of(docs, text_col) if total_bytes is None else total_bytes
    dealt = source.repartitionByRange(int(-(-total // range_bytes)) or 1, "place").sortWithinPartitions("place", "text")
    dealt.select("id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_tokens(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each document, all from the files of token_files(), one file after another.

    id_type: "string" for ids that are strings, else the whole number type of the ids.
    """
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    files = manifest.repartition(int(total >> 22) + manifest.sparkSession.sparkContext.defaultParallelism, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, path in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "path")), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    matrix, about = WaveletMatrix.from_bytes(f.read())
                ids, ends = matrix.ids(), np.cumsum(about["counts"])
                starts = ends - about["counts"]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(crc)), pa.array([seq] * len(crc)), pa.array(about["ids"], kind), pa.array(starts), pa.array(np.asarray(about["counts"], np.int64)), pa.array(crc, pa.int64())], ["part", "seq", "id", "inside", "n_tokens", "ids_crc32"])

    kind = pa.string() if id_type == "string" else {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[id_type]
    docs = files.mapInArrow(run, f"part long, seq long, id {id_type}, inside long, n_tokens long, ids_crc32 long")
    shards = manifest.select("part", "seq", "n_tokens")

    def before(*by: str):
        w = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n_tokens").over(w), F.lit(0))

    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("whole", before("part")).select("part", "whole")  # a row for each range of the order
    at = shards.withColumn("inner", before("part", "seq")).join(parts, "part").select("part", "seq", (F.col("whole") + F.col("inner")).alias("base"))
    return docs.join(at, ["part", "seq"]).select("id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(token_files(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_wavelet_tokens": op9_wavelet_tokens}
