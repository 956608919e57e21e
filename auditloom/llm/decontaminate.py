"""Benchmark decontamination: an FM-index for each shard of the corpus, searched backwards for all benchmark windows."""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, table
from .fm_index import FMIndex
from .vectext import cuts, hashes, lengths, runs

_IS_WORD = np.zeros(256, bool)  # in UTF-8, of lower-cased text: the contract's class, byte by byte
_IS_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
_GAP = 1  # the symbol between documents


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z alone


class Block:
    """The windows of some benchmark items, as places in one row of their words: an item of fewer than `size` words is one
    window, one of none has none."""

    def __init__(self, items: list[str], texts: list[bytes], size: int):
        self.items, self.buf = items, np.frombuffer(b"\n".join(texts), np.uint8)
        self.begin, self.end = runs(_IS_WORD[self.buf])
        self.codes = hashes(self.buf, self.begin, self.end)
        first = np.searchsorted(self.begin, np.cumsum([0, *(len(x) + 1 for x in texts)]))
        words = np.diff(first)
        n = np.where(words > 0, np.maximum(1, words - size + 1), 0)
        self.item = np.repeat(np.arange(len(items)), n)
        self.start = np.repeat(first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.len = np.repeat(np.minimum(words, size), n)

    def words(self, window: int) -> list[bytes]:
        at = range(self.start[window], self.start[window] + self.len[window])
        return [self.buf[self.begin[i] : self.end[i]].tobytes() for i in at]


_BLOCKS: OrderedDict[str, list[Block]] = OrderedDict()  # of the last benchmark that a worker used, if small


def blocks_of(folder: str, size: int, most: int = 8 << 20) -> Iterator[Block]:
    """The blocks of a benchmark table, one at a time. A worker keeps those of a benchmark of up to `most` bytes of text."""
    if (known := f"{folder} {size}") in _BLOCKS:
        yield from _BLOCKS[known]
        return
    store, path = fs.FileSystem.from_uri(folder)
    held, total = [], 0
    for rows in dataset(path, filesystem=store, format="parquet").to_batches(batch_size=1, batch_readahead=1, fragment_readahead=1):
        for items, texts in zip(rows["items"].to_pylist(), rows["texts"].to_pylist(), strict=True):
            block, total = Block(items, texts, size), total + sum(map(len, texts))
            if total <= most:
                held.append(block)
            else:
                held.clear()
            yield block
    if total <= most:
        _BLOCKS.clear()
        _BLOCKS[known] = held


class Shard:
    """The FM-index over the words of some texts, each different text once."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        buf = np.frombuffer(b"\n".join(texts), np.uint8)
        self.starts, self.ends = runs(_IS_WORD[buf])
        self.offset = np.cumsum([0, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(self.starts, self.offset)  # the first word of each text, and one more
        self.vocabulary, ids = np.unique(hashes(buf, self.starts, self.ends), return_inverse=True)
        self.at = np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(self.first))  # places of the words among gaps
        t = np.full(len(ids) + len(texts), _GAP, np.int64)
        t[self.at] = ids + 2
        self.index = FMIndex(t)
        self.points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.uint32)])  # code points before each byte

    def find(self, block: Block) -> Iterator[tuple[int, int, int]]:
        """(text, first word, window) for each occurrence of the block's windows."""
        if not len(self.vocabulary) or not len(block.start):
            return
        where = np.minimum(np.searchsorted(self.vocabulary, block.codes), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[where] == block.codes, where + 2, -1)
        low, high = self.index.search_in(symbols, block.start, block.len)
        n = high - low
        rows = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        place, which = self.index.locate(rows), np.repeat(np.arange(len(n)), n)
        word = np.searchsorted(self.at, place)
        text = np.searchsorted(self.first, word, "right") - 1
        wanted: dict[int, list[bytes]] = {}
        for d, w, p in zip(text.tolist(), word.tolist(), which.tolist(), strict=True):
            if p not in wanted:
                if len(wanted) > 4096:
                    wanted.clear()
                wanted[p] = block.words(p)
            at = int(self.offset[d])
            if all(self.texts[d][self.starts[i] - at : self.ends[i] - at] == x for i, x in zip(range(w, w + len(wanted[p])), wanted[p], strict=True)):  # hashes of 64 bits are not proof
                yield d, w - int(self.first[d]), p

    def span(self, text: int, first: int, last: int) -> tuple[int, int]:
        """Code points [start, end) of words first to last."""
        at = int(self.points[self.offset[text]])
        return int(self.points[self.starts[self.first[text] + first]]) - at, int(self.points[self.ends[self.first[text] + last]]) - at


def _merged(occurrences: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(occurrences)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(first word, last, first code point, last) of pieces' spans, those that touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2], max(d, out[-1][3]))
        else:
            out.append((a, b, c, d))
    return out


def stored_blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> str:
    """Writes the benchmark to the shared folder as a table of blocks, lists of items and of lower-cased texts of block_bytes
    at most (or one longer item); returns its place. Spark's tasks make the blocks: nothing passes through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for to in cuts(batch.column("t"), block_bytes):
                part = batch.slice(done, to - done)
                done = to
                yield pa.RecordBatch.from_arrays([pa.array([part.column("i").to_pylist()], pa.list_(pa.string())), pa.array([[lowered(x) for x in part.column("t").to_pylist()]], pa.list_(pa.binary()))], ["items", "texts"])

    at = f"{shared_dir(bench.sparkSession)}/benchmark-{uuid.uuid4().hex}"
    rows = bench.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    rows.mapInArrow(run, "items array<string>, texts array<binary>").write.parquet(at)
    return at


def pieces_of(text: bytes, most: int, overlap: int) -> list[tuple[int, int, bytes]]:
    """(byte, word, piece): a text of over `most` bytes in pieces that begin at a word and reach `overlap` words into the next."""
    if len(text) <= most:
        return [(0, 0, text)]
    begin, end = runs(_IS_WORD[np.frombuffer(text, np.uint8)])
    out, word = [], 0
    while word < len(begin):
        to = max(word + 1, int(np.searchsorted(begin, begin[word] + most)))
        out.append((int(begin[word]), word, text[begin[word] : end[min(len(begin), to + overlap) - 1]]))
        word = to
    return out or [(0, 0, b"")]


def contamination(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  keep: tuple[str, ...] = (), size: int = 13, share: int = 20, shard_bytes: int = 6 << 20, block_bytes: int = 1 << 20, piece_bytes: int = 12 << 20) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, and the columns in keep.

    Tasks cut their rows into shards of about shard_bytes of text, index each different text of a shard once and search the
    benchmark's windows of `size` words block by block. A longer text is a shard of its own, one of over piece_bytes is
    indexed in pieces that overlap by a window, so that no index grows with a text. items: ids as sorted strings; spans:
    the merged removal spans in code points, end exclusive. contaminated: n_hit > 0 and share * n_hit >= n_words. No
    shuffle; a lost task is redone from its input rows. The benchmark is a table of blocks of block_bytes in the shared
    folder, and a task reads one block at a time, so its size is bounded by nothing but time. Null or empty texts have no words; repeated rows each get a row; an empty benchmark or
    empty docs give no hits or no rows; null item ids own no windows. Other columns are not read.
    """
    folder = stored_blocks(bench, item_col, item_text_col, block_bytes)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c) for c in keep if c not in (id_col, text_col)))
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
             T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    kept = [f for f in source.schema.fields if f.name != "text" or text_col in keep]
    result = T.StructType(kept + added)
    names = [f.name for f in kept]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def shard(rows: pa.Table) -> pa.RecordBatch:
        texts = [lowered(x) for x in rows["text"].to_pylist()]
        order = {x: i for i, x in enumerate(dict.fromkeys(texts))}
        distinct = list(order)
        found: list[set[str]] = [set() for _ in order]
        merged: list[list] = [[] for _ in order]
        n_words, whole = [0] * len(order), [x for x in order if len(x) <= piece_bytes]
        indexed = [(whole, [(order[x], 0, 0) for x in whole])] if whole else []
        for x in order:  # an index for each piece of a very long text, one after another
            if len(x) > piece_bytes:
                indexed += [([piece], [(order[x], byte, word)]) for byte, word, piece in pieces_of(x, piece_bytes, size - 1)]
        for some, owners in indexed:
            s, hits = Shard(some), {}
            for block in blocks_of(folder, size):
                for d, w, p in s.find(block):
                    hits.setdefault(d, set()).add((w, w + int(block.len[p])))
                    found[owners[d][0]].add(block.items[block.item[p]])
            for d, (i, byte, word) in enumerate(owners):
                n_words[i] = max(n_words[i], word + int(s.first[d + 1] - s.first[d]))
                base = len(distinct[i][:byte].decode()) if byte else 0
                for a, b in _merged(list(hits.get(d, ()))):
                    merged[i].append((word + a, word + b, *(base + c for c in s.span(d, a, b - 1))))
        one: list[tuple] = []
        for i, n in enumerate(n_words):
            ids, spans = sorted(found[i]), _joined(merged[i])
            hit = sum(b - a for a, b, *_ in spans)
            one.append((n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and share * hit >= n, ids, [{"start": c, "end": d} for *_, c, d in spans]))
        cols = list(zip(*(one[order[x]] for x in texts), strict=True))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), kind]
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in names), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*names, *(f.name for f in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_now = [], 0
        for batch in batches:
            cut = 0
            for i, n in enumerate(lengths(batch.column("text")).tolist()):
                size_now += n
                if size_now >= shard_bytes:
                    yield shard(pa.Table.from_batches([*held, batch.slice(cut, i + 1 - cut)]))
                    held, size_now, cut = [], 0, i + 1
            if cut < batch.num_rows:
                held.append(batch.slice(cut))
        if held:
            yield shard(pa.Table.from_batches(held))

    out = source.mapInArrow(run, result)
    return out.withColumnRenamed("id", id_col)


def without_spans(text, spans):
    """Column: text with the spans (code points, sorted, disjoint) cut out."""
    pieces = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("out"), s["end"].alias("at")))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(pieces["out"], F.substring(text, (pieces["at"] + 1).cast("int"), F.lit(2**31 - 1))))


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Documents without the contaminated ones; in the others the removal spans are cut out and n_chars follows the text."""
    cols = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # own names, so that none of docs' clashes with the added ones
    plain = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in cols.items()))
    rows = contamination(plain, bench, id_col=cols["doc_id"], text_col=cols["text"], keep=tuple(cols.values())).where(~F.col("contaminated"))
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), without_spans(F.col("text"), F.col("spans"))))
    out = {c: F.col("text" if c == "text" else x) for c, x in cols.items()}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return rows.select(*(x.alias(c) for c, x in out.items()))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


QUERIES = {"op1_decontaminate": op1_decontaminate}

ORACLE_SQL = {
    "op1_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS k FROM i),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
hit AS (SELECT pos.r, pos.p, win.n, win.item_id FROM pos CROSS JOIN sizes JOIN win ON win.n = sizes.n AND win.k = array_to_string(pos.w[pos.p:pos.p + sizes.n - 1], ' ') WHERE pos.p + sizes.n - 1 <= len(pos.w)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
}
