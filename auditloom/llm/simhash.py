"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments, join, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, row_hash, stored, table

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width; 23 bits, the code's length, with zeros above
REACH = 2  # differing bits that link
#: Fixed value: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code (23, 12).
GENERATOR = 0b110001110101


def fingerprint(text: str | None, size: int = 3, step: int = 1 << 15) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; no words: 0."""
    words = (text or "").encode().lower().split()  # bytes: A-Z, and \\x20 \\x09-\\x0D as white space
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    starts = np.cumsum([0, *map(len, words)])[:-1] + np.arange(len(words))
    ends = starts + [len(w) for w in words]
    n = max(1, len(words) - size + 1)
    a, b = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, step):
        h = np.array([xxhash.xxh64_intdigest(line[x:y], 42) for x, y in zip(a[at : at + step], b[at : at + step], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id_col, fp, tag) for each row of docs; tag is what xxhash64(text) is in SQL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column("text").to_pylist()
                fp = [fingerprint(x, size) for x in texts]
                tag = np.array([42 if x is None else xxhash.xxh64_intdigest(x, 42) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp, pa.int64()), pa.array(tag)], ["id", "fp", "tag"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long, tag long").withColumnRenamed("id", id_col)


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    v = np.asarray(v, np.int64).copy()
    for k in range(22, 10, -1):
        v ^= np.where(v >> k & 1, GENERATOR << (k - 11), 0)
    return v


def error_table() -> np.ndarray:
    """For each of the 2048 syndromes, the errors of weight 4 or less that lead to a codeword: one, or six; 0 fills up.

    The code is perfect: one error of weight 3 or less has each syndrome. If its weight is 3, five of weight 4 have it too.
    """
    errors = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    s = syndrome(errors)
    order = np.argsort(s, kind="stable")
    s, errors = s[order], errors[order]
    first = np.searchsorted(s, np.arange(2048))
    out = np.full((2048, 6), -1, np.int64)
    out[s, np.arange(len(s)) - first[s]] = errors
    return out


def codewords(v: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 of each 23-bit word, -1 where there are fewer than 6.

    Two words at most 2 apart share one: the codeword within 3 of the word between them is within 4 of both.
    """
    e = errors[syndrome(v)]
    return np.where(e >= 0, (np.asarray(v, np.int64)[:, None] ^ e) >> 11, -1)  # the upper 12 bits tell codewords apart


def keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): for each of the three segments one is taken exactly, the next by its nearby codewords.

    Two errors leave one of three segments without any; the next segment then has two at most. So fingerprints that link
    share a key. Up to 18 keys each: segment number, its bits, codeword index.
    """
    errors = error_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            part = [fp >> at & ((1 << width) - 1) for at, width in SEGMENTS]
            for i in range(3):
                c = codewords(part[(i + 1) % 3], errors)
                key = (np.int64(i) << 40) | (part[i][:, None] << 12) | c
                yield pa.RecordBatch.from_arrays([pa.array(key[c >= 0]), pa.array(np.repeat(fp, (c >= 0).sum(axis=1)))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def links(nodes: DataFrame, bucket: int = 64) -> DataFrame:
    """(a, b) of fingerprints at most 2 bits apart: enough of these links to connect whatever links connect.

    Keys shared by up to `bucket` fingerprints are joined with themselves and each pair is verified. The fingerprints of
    larger buckets are not paired: each is listed under itself and under its 64 words one bit away. Two that meet under a
    word are 2 bits apart at most, and two that link meet (under the word between them), so joining each to the least
    one of a word loses no connection; a word has 65 members at most.
    """
    every = stored(keys(nodes), "golay")
    held = stored(every.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"), "golay")
    small = held.where(F.col("n") <= bucket).select("key", "fp")
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(np.int64(1 << b) if b < 63 else np.int64(-(2**63))).cast("long") for b in range(64)))
    large = held.where(F.col("n") > bucket).select("fp").distinct().withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    stars = large.withColumn("a", F.min("fp").over(Window.partitionBy("word"))).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str, size: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id, fp, tag) of all rows, and (fp, component) of all fingerprints; component is the least fingerprint reachable."""
    rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, size=size).withColumnRenamed(id_col, "id"), "fingerprints")
    nodes = rows.select("fp").distinct()
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    return rows, stored(nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")), "groups")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id.

    Rows link where their SimHash fingerprints (XXH64 of word shingles, seed 42) differ in 2 bits or fewer; component_id
    is the smallest id reachable. All links are between different fingerprints, so that copies never meet in pairs.
    Null, empty and blank texts have fingerprint zero and link like any other; repeated rows share a component;
    component_id is null only where all ids of a component are; empty docs give no rows. Other columns are not read.
    """
    rows, groups = grouped(docs, id_col, text_col, size)
    least = rows.groupBy("fp").agg(F.min("id").alias("least")).join(groups, "fp")
    final = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return rows.join(final, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (null last), then by hashes of its
    text and of the whole row."""
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)))
    key, text = f"_{docs.columns.index('doc_id')}", f"_{docs.columns.index('text')}"
    rows, groups = grouped(plain, key, text)
    first = lambda c: F.min(F.struct(F.col("id").isNull().alias("n"), "id", "tag")).alias(c)
    one = rows.groupBy("fp").agg(first("r")).join(groups, "fp").groupBy("component").agg(F.min("r").alias("r")).select(F.col("r.id").alias("id"), F.col("r.tag").alias("tag"))
    marked = plain.withColumn("tag", F.xxhash64(text))
    kept = marked.join(one, marked[key].eqNullSafe(one["id"]) & (marked["tag"] == one["tag"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy(key, "tag").orderBy("row"))
    return kept.withColumn("row", row_hash(plain)).withColumn("turn", turn).where("turn = 1").select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
