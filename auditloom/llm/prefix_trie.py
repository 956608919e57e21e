"""The prefix trie of conversations: balanced parentheses for each shard of the sorted paths, shared spines merged."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

DIGEST = 16  # bytes that stand for a turn, of SHA-256
NO_ENDS = hashlib.sha256(b"").hexdigest()
COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


class Parens:
    """A tree as balanced parentheses (1 opens, 0 closes): packed bits, and for each block the excess before it and its least
    and greatest excess, with a tree of these over the blocks."""

    BLOCK = 128

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        fill = -self.n % self.BLOCK
        rows = np.concatenate([bits, np.ones(fill, np.uint8)]).reshape(-1, self.BLOCK)  # what fills up opens, so it closes nothing
        self.words = np.packbits(rows, axis=1)
        steps = rows.astype(np.int64) * 2 - 1
        after = np.cumsum(steps, axis=1)
        self.before = np.concatenate([[0], np.cumsum(after[:, -1])])
        self.low, self.high = [after.min(axis=1) + self.before[:-1]], [after.max(axis=1) + self.before[:-1]]
        while len(self.low[-1]) > 1:
            for levels, of in ((self.low, np.minimum), (self.high, np.maximum)):
                x = levels[-1]
                x = np.append(x, x[-1]) if len(x) % 2 else x
                levels.append(of(x[::2], x[1::2]))
        self.ones = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.pairs = np.concatenate([[0], np.cumsum((bits == 1) & (np.append(bits[1:], 1) == 0))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Opening parentheses before i."""
        return self.ones[i]

    def leaf_rank(self, i: np.ndarray) -> np.ndarray:
        """Pairs () that begin before i."""
        return self.pairs[i]

    def _within(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place in each block, beyond `after`, where the excess falls to the target; -1: none."""
        out = np.empty(len(block), np.int64)
        for a in range(0, len(block), 1 << 15):
            part = slice(a, a + (1 << 15))
            rows = np.unpackbits(self.words[block[part]], axis=1).astype(np.int16) * 2 - 1
            level = np.cumsum(rows, axis=1, dtype=np.int16) + self.before[block[part]][:, None]
            hit = (level <= target[part][:, None]) & (np.arange(self.BLOCK) > after[part][:, None])
            first = hit.argmax(axis=1)
            out[part] = np.where(hit[np.arange(len(first)), first], first, -1)
        return out

    def find_close(self, i: np.ndarray) -> np.ndarray:
        """The places of the parentheses that close those at i."""
        block = i // self.BLOCK
        target = 2 * self.ones[i] - i  # the excess before i
        at = self._within(block, i % self.BLOCK, target)
        out = block * self.BLOCK + at
        left = np.flatnonzero(at < 0)
        node, goal = block[left], target[left]
        found = np.full(len(left), -1)  # at which level a node to the right holds it
        for level, low in enumerate(self.low[:-1]):
            up = found < 0
            right = up & (node % 2 == 0) & (node + 1 < len(low))
            right[right] = low[node[right] + 1] <= goal[right]
            found[right] = level
            node = np.where(right, node + 1, np.where(up, node // 2, node))
        for level in range(len(self.low) - 1, 0, -1):
            down = found == level
            child = 2 * node[down]
            node[down] = child + (self.low[level - 1][child] > goal[down])
            found[down] = level - 1
        out[left] = node * self.BLOCK + self._within(node, np.full(len(node), -1), goal)
        return out


def range_min(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of a[low:high] for each non-empty range, from minima over powers of two, one power at a time."""
    power = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), a.dtype)
    for k in range(int(power.max(initial=0)) + 1):
        use = power == k
        out[use] = np.minimum(a[low[use]], a[high[use] - (1 << k)])
        a = np.minimum(a[: -(1 << k)], a[1 << k :]) if len(a) > 1 << k else a
    return out


class Shard:
    """The trie of paths added in ascending order, as balanced parentheses and rows of numbers in preorder."""

    def __init__(self):
        self.bits, self.depth, self.size, self.parent = bytearray(b"\1"), array("q", [0]), array("q", [0]), array("q", [-1])
        self.ids, self.end_at = array("q"), array("q")
        self.first = self.path = None
        self.stack = [0]

    def add(self, path: bytes, sizes: list[int], conv: int) -> None:
        n, shared = len(path) // DIGEST, 0
        if self.path is None:
            self.first = path
        else:
            most = min(len(self.path), len(path))
            if self.path[:most] == path[:most]:
                shared = most // DIGEST
            else:
                while self.path[shared * DIGEST : (shared + 1) * DIGEST] == path[shared * DIGEST : (shared + 1) * DIGEST]:
                    shared += 1
            self.bits += bytes(len(self.path) // DIGEST - shared)
        new = range(len(self.depth), len(self.depth) + n - shared)
        if new:
            self.bits += b"\1" * len(new)
            self.depth.extend(range(shared + 1, n + 1))
            self.size.extend(sizes[shared:])
            self.parent.append(self.stack[shared])
            self.parent.extend(new[:-1])
        self.stack[shared + 1 :] = new
        self.path = path
        self.ids.append(conv)
        self.end_at.append(self.stack[n])

    def nodes(self) -> dict[str, np.ndarray | list]:
        """Columns in preorder."""
        bits = np.frombuffer(bytes(self.bits) + bytes(len(self.stack)), np.uint8)
        tree = Parens(bits)
        opens = np.flatnonzero(bits)
        close = tree.find_close(opens)
        v, last = np.arange(len(opens)), tree.rank(close)  # a subtree is the nodes v to last
        as_np = lambda x: np.frombuffer(x, np.int64)
        ids, at, size, parent = as_np(self.ids), as_np(self.end_at), as_np(self.size), as_np(self.parent)
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])
        ended = upto(np.bincount(at, minlength=len(v)))
        convs = ended[last] - ended[v]
        saved = upto((convs - 1) * size)
        smallest = np.full(len(v), np.iinfo(np.int64).max)
        smallest[at[::-1]] = ids[::-1]  # of the ids of one path, which ascend, the first
        conv = range_min(smallest, v, last)
        where = np.flatnonzero(np.diff(at, prepend=-1))
        ends = {int(at[a]): ",".join(map(str, ids[a:b].tolist())) for a, b in zip(where.tolist(), [*where[1:].tolist(), len(ids)], strict=True)}
        first, tail = len(self.first) // DIGEST, len(self.stack) - 1
        keys: dict[int, bytes] = {}
        for path, nodes in ((self.first, range(first + 1)), (self.path, self.stack)):
            h = hashlib.sha256()
            for d, node in enumerate(nodes):
                h.update(path[(d - 1) * DIGEST : d * DIGEST] if d else b"")
                keys[node] = h.digest()
        lasts = set(self.stack)
        return {
            "depth": as_np(self.depth), "size": size, "conv_id": conv, "n_convs": convs, "n_children": np.bincount(parent[1:], minlength=len(v)),
            "n_leaves": tree.leaf_rank(close) - tree.leaf_rank(opens), "saved_tokens": saved[last] - saved[v],
            "key": [keys.get(i) for i in range(len(v))], "parent_key": [keys.get(p) for p in self.parent],
            "parent_conv_id": [None if p < 0 or p in keys else int(conv[p]) for p in self.parent],
            "ends": [ends.get(i, "") if i in keys else hashlib.sha256(ends[i].encode()).hexdigest() if i in ends else NO_ENDS for i in range(len(v))],
            "first": [i <= first for i in range(len(v))], "tail": [tail if i in lasts else None for i in range(len(v))],
        }


NODES = "shard int, depth long, size long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key binary, parent_key binary, parent_conv_id long, ends string, first boolean, tail long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, NODES.split(", "))])


def _shards(batches: Iterator[pa.RecordBatch], step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    shard = Shard()
    for batch in batches:
        for path, sizes, conv in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "conv_id")), strict=True):
            shard.add(path, sizes, conv)
    if shard.path is None:
        return
    nodes = shard.nodes() | {"shard": np.full(len(shard.depth), TaskContext.get().partitionId(), np.int32)}
    for a in range(0, len(shard.depth), step):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[f.name][a : a + step], f.type) for f in _SCHEMA], schema=_SCHEMA)


def paths(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path): a row for each conversation, its turns in order as structs of a digest of role and text and the text's bytes.

    Null turns come first; turns of one number are in the order of their digests, and none is left out. Null roles and texts
    count as empty. Rows without a conversation are of none. Only digests are shuffled, 28 bytes a turn; a conversation's
    are one row.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.unhex(digest).alias("digest"), F.octet_length(text).alias("size")).alias("t"))
    dealt = turns.repartition(F.expr("conv_id - conv_id % 5"))
    rows = dealt.groupBy(F.expr("conv_id - conv_id % 5").alias("five"), "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("path"))


def trie(paths: DataFrame, *, shard_turns: int = 1 << 20) -> DataFrame:
    """A row for each different prefix (node) of paths as from paths(): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    conv_id: the least of the conversations that begin so (members); n_convs: how many; parent_conv_id: the parent's
    conv_id, null for the root, which is the empty prefix; n_children; n_leaves: childless nodes in the subtree, which
    includes its top; saved_tokens: sum over the subtree of (n_convs - 1) times the bytes of the node's last text;
    ends_sha256: digest of the ids, ascending, of members that end there. No paths give no rows; a conversation without
    turns ends at the root.

    Paths are sorted by their digests, then id, into ranges of about shard_turns turns; so conversations that are alike,
    however many, go to as many shards as they fill. A shard is a tree as balanced parentheses, whose subtrees are those
    ranges of the preorder that end at the closing parentheses. A node can only be in several shards if it is on the first
    or last path of each; those (two paths a shard) are merged by sums, less what neighbours count twice: for each pair of
    neighbours, what they share is one path from the root. The ids that end at a shared node are hashed as a stream.
    """
    spark = paths.sparkSession
    digests = F.unhex(F.array_join(F.transform("path", lambda x: F.hex(x["digest"])), ""))
    rows = stored(paths.select(digests.alias("path"), F.transform("path", lambda x: x["size"].cast("long")).alias("sizes"), "conv_id"), "trie-paths")
    total = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-total // shard_turns))
    dealt = rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = stored(dealt.mapInArrow(_shards, NODES), "trie-nodes")

    spine = nodes.where("key is not null")
    following = spine.where("depth = 0").select("shard", F.lead("shard").over(Window.partitionBy(F.lit(0)).orderBy("shard")).alias("next")).where("next is not null")  # a number for each shard
    shared = spine.where("tail is not null").join(following, "shard").join(spine.where("first").select(F.col("shard").alias("next"), "key"), ["next", "key"])
    of = Window.partitionBy("shard")
    below = of.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    cut = shared.select("key", "depth", "tail", F.max("depth").over(of).alias("most"), F.sum("size").over(below).alias("saved_tokens"))
    twice = cut.select("key", F.lit(0).cast("long").alias("n_convs"), (-(F.col("depth") < F.col("most")).cast("long")).alias("n_children"), (-(F.col("tail") == F.col("most")).cast("long")).alias("n_leaves"), "saved_tokens")
    names = spine.select("key", *COUNTS, "conv_id", "depth", "parent_key")
    merged = names.unionByName(twice, allowMissingColumns=True).groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"))
    merged = stored(merged, "trie-spines")

    least = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    tops = merged.join(least, "parent_key", "left").join(_digests(spine), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    inner = nodes.where("key is null").withColumn("ends_sha256", F.col("ends"))
    out = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]
    # the children of a spine's nodes meet them shard by shard, so that those of the root are spread
    known = spine.select("shard", F.col("key").alias("parent_key")).join(least, "parent_key")
    hung = inner.where("parent_key is not null").drop("parent_conv_id").join(known, ["shard", "parent_key"])
    return tops.select(out).unionByName(inner.where("parent_key is null").select(out)).unionByName(hung.select(out))


def _digests(spine: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes on spines: their ids, ascending from shard to shard, hashed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])
        for batch in batches:
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key != now:
                    if h:
                        yield row()
                    now, h = key, hashlib.sha256(ends.encode())
                else:
                    h.update(f",{ends}".encode())
        if h:
            yield row()

    pieces = spine.where("ends <> ''").select("key", "shard", "ends")
    return pieces.repartition("key").sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of c - c % 5 in place of its own first h; h: CRC-32 of its decimal id, modulo 9."""
    heads = paths.where("conv_id % 5 = 0").select(F.col("conv_id").alias("five"), F.slice("path", 1, 8).alias("head"))
    h = F.expr("int(crc32(cast(conv_id as string)) % 9)")
    joined = paths.withColumn("five", F.expr("conv_id - conv_id % 5")).join(heads, "five", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("path", 1, 0)), F.lit(1), h), F.slice("path", h + 1, F.size("path"))).alias("path"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(paths(table(spark, sf_dir, "conversations"))))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL = {
    "op12_prefix_trie": """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
own AS (
  SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[:32]) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS five,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc),
k AS (SELECT c.*, least(h, coalesce(n, 0)) AS taken FROM c LEFT JOIN (SELECT conv_id AS five, count(*) AS n FROM own GROUP BY ALL) USING (five)),
turns AS (
  SELECT k.conv_id, pos + 1 AS depth, digest, size FROM k JOIN own ON own.conv_id = k.five AND pos < h
  UNION ALL SELECT k.conv_id, taken + pos - h + 1, digest, size FROM k JOIN own ON own.conv_id = k.conv_id AND pos >= h),
prefixes AS (
  SELECT conv_id, depth, size, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
ends AS (SELECT conv_id, max_by(key, depth) AS key FROM prefixes GROUP BY ALL),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM prefixes GROUP BY ALL),
stopped AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS d FROM ends GROUP BY ALL),
kids AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
under AS (
  SELECT p.key, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved
  FROM node v LEFT JOIN kids ON kids.key = v.key JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY ALL)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(stopped.d, sha256('')) AS ends_sha256
FROM node JOIN under USING (key) LEFT JOIN kids USING (key) LEFT JOIN stopped USING (key)
LEFT JOIN node up ON node.depth > 0 AND up.key = left(node.key, length(node.key) - 32)"""
}
