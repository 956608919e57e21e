"""Byte-level BPE: longest matches by an Aho-Corasick automaton, put right by backtracking; decoding by a table."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectext import cuts


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """The BPE of a vocabulary of ranks, in time linear in a piece.

    The ids of a piece are the only row of tokens in which each pair of neighbours, on its own, would be encoded as that
    pair. So: take the longest token at each place (all matches of a piece come from one pass of the automaton over its
    bytes, as Latin-1); if it doesn't go with the token before, take its longest prefix that is a token; if none is left,
    go back by a token. A place that was left in this way is never entered again, so that the steps are linear. Whether two
    tokens go together is known by undoing their merges from the last rank down, and kept for later.

    Needs every byte as a token, and merges whose parts rank below the whole (any trained BPE); raises if not.
    """

    def __init__(self, ranks: dict[bytes, int], most_kept: int = 1 << 19):
        self.ranks, self.most = ranks, most_kept
        self.bytes_of = bytes_of(tuple(ranks.items()))
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix
        self.parts: dict[int, tuple[int, int]] = {}  # the last merge that makes a token; none: it is never made
        self.together: dict[tuple[int, int], bool] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            prefixes = [ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks]
            if not prefixes:
                continue
            self.shorter[rank] = prefixes[0]
            for left in prefixes:
                right = ranks.get(token[len(self.bytes_of[left]) :])
                if right is not None and left < rank and right < rank and self.compatible(left, right, rank):
                    self.parts[rank] = left, right
                    break
            else:
                raise ValueError(f"no merge of lower ranks makes token {rank}")
        self.together.clear()
        self.automaton.make_automaton()

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether BPE of both tokens' bytes keeps them apart; of merges below `limit` only, if given."""
        known = self.together.get((left, right))
        if known is not None:
            return known
        bytes_of, ranks, parts = self.bytes_of, self.ranks, self.parts
        a, b = left, right
        bound = limit if limit is not None else len(bytes_of)  # merges across the cut count only if they come before the ones that were undone
        out = True
        while True:
            merged = ranks.get(bytes_of[a] + bytes_of[b])
            if merged is not None and merged < bound:
                out = False
                break
            # undo the later of the two last merges; at equal times the left one came first, so undo the right one
            if a > b and a in parts:
                bound, a = a, parts[a][1]
            elif b in parts:
                bound, b = b + 1, parts[b][0]
            elif a in parts:
                bound, a = a, parts[a][1]
            else:
                break
        if len(self.together) >= self.most:
            self.together.clear()
        self.together[left, right] = out
        return out

    def longest(self, piece: bytes) -> list[int]:
        """The longest token at each place."""
        out = [0] * len(piece)
        for end, (rank, n) in self.automaton.iter(piece.decode("latin-1")):
            out[end - n + 1] = rank  # later ends are longer matches
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece that isn't to be split by the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None or not piece:
            return [whole] if piece else []
        longest, open_, bytes_of, shorter = self.longest(piece), bytearray(b"\1") * (len(piece) + 1), self.bytes_of, self.shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            to = at + len(bytes_of[token])
            if open_[to] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = to
                token = longest[at] if at < len(piece) else 0
            elif token in shorter:
                token = shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= len(bytes_of[token])
        return out

    def packed(self, text: str, split: Callable[[str], Iterator], step: int = 1 << 16) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; its pieces are met `step` at a time."""
        found, out = split(text), []
        known = self.pieces
        while pieces := [m[0] for m in islice(found, step)]:
            row = []
            for p in pieces:
                ids = known.get(p)
                if ids is None:
                    ids = np.array(self.encode(p.encode()), "<u4").tobytes()
                    if len(p) <= 64:
                        if len(known) >= self.most:
                            known.clear()
                        known[p] = ids
                row.append(ids)
            out.append(b"".join(row))
        return b"".join(out)


@lru_cache(2)
def bpe_of(ranks: tuple[tuple[bytes, int], ...]) -> Bpe:
    """A worker's encoder; what it knows serves later tasks."""
    return Bpe(dict(ranks))


@lru_cache(2)
def bytes_of(ranks: tuple[tuple[bytes, int], ...]) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(rank for _, rank in ranks) + 1)
    for token, rank in ranks:
        out[rank] = token
    return out


def decode(packed: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _vocabulary(spark: SparkSession, path: str | None):
    """The ranks, read on the driver and sent to all: they don't grow with the data."""
    return spark.sparkContext.broadcast(tuple(read_ranks(path or default_ranks()).items()))


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, ids) for each row: the ids of its text as binary, each a little-endian unsigned 32-bit integer.

    The text is split by the pattern and each match encoded by itself, as the public library for these files does, without
    special tokens. Rows keep their order and partition; nothing is shuffled. Null texts count as empty, which have no ids;
    bytes that aren't UTF-8 become U+FFFD; repeated rows and null ids are rows like others; empty docs give no rows. Other
    columns are not read.
    """
    ranks, split = _vocabulary(docs.sparkSession, ranks_path), pattern or default_pattern()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = bpe_of(ranks.value), regex.compile(split).finditer
        for batch in batches:
            at = 0
            for to in cuts(batch.column("text"), 4 << 20):
                part = batch.slice(at, to - at)
                at = to
                ids = [bpe.packed(x.decode("utf-8", "replace"), pieces) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decoded(encodings: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """(id_col, ids_col, bytes) for each row of ids as from encoded(): the bytes that they stand for. Null ids of a text have none."""
    ranks = _vocabulary(encodings.sparkSession, ranks_path)
    plain = encodings.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bytes_of(ranks.value)
        for batch in batches:
            at = 0
            for to in cuts(batch.column("ids"), 4 << 20):
                part = batch.slice(at, to - at)
                at = to
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array((decode(x, tokens) for x in part.column("ids").to_pylist()), pa.binary())], ["id", "ids", "bytes"])

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids binary, bytes binary").withColumnsRenamed({"id": id_col, "ids": ids_col})


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
