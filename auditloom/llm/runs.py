"""Periodic runs of words: a Re-Pair grammar for each document, runs across each symbol's boundary once, maximal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectext import cuts

LEAST = 12  # words of a run; and it has twice its period at least
GRAM = LEAST // 2
SPACES = "[\\x20\\x09-\\x0D]+"


def expanded(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which number, for all numbers of the ranges low, low + 1, ... of so many."""
    of = np.repeat(np.arange(len(low)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]


def repeated(key: np.ndarray) -> np.ndarray:
    """Indices of keys that others equal, sorted by key, then index."""
    bits = max(10, int(len(key)).bit_length() + 2)
    cell = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.bincount(cell, minlength=1 << bits)[cell] > 1)  # most of those that are alone go here
    some = some[np.argsort(key[some], kind="stable")]
    same = key[some][1:] == key[some][:-1]
    return some[(np.append(same, False) | np.append(False, same))[: len(some)]]


def repair(words: np.ndarray, doc: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Re-Pair of many documents at once, each with a grammar of its own.

    words: ids of the words, document after document; doc: ascending. In each round the pairs of neighbours that a document
    has twice or more (without overlaps) are counted, and a pair is replaced wherever it is more frequent than the pairs
    that overlap it; a document's most frequent pair always is. This goes on until no document has a pair twice. Returns
    the occurrences of all symbols made (rule, start, mid, end; places in words), and what remains of the documents
    (start, end, doc), whose symbols are in place order.
    """
    symbol, start, at_doc = words.astype(np.int64), np.arange(len(words)), doc.astype(np.int64)
    end, live = start + 1, np.ones(len(words), bool)  # live: pairs that can occur twice
    names, made, done = int(words.max(initial=0)) + 1, [], []
    while len(symbol):
        i = np.flatnonzero(live[:-1] & (at_doc[1:] == at_doc[:-1]))
        a, b = symbol[i], symbol[i + 1]
        if (twins := a == b).any():  # of aaa the second pair is none: every second place of a stretch of one symbol
            new = np.append(True, (symbol[1:] != symbol[:-1]) | (at_doc[1:] != at_doc[:-1]))
            begun = np.maximum.accumulate(np.where(new, np.arange(len(symbol)), 0))
            keep = ~twins | ((i - begun[i]) % 2 == 0)
            i, a, b = i[keep], a[keep], b[keep]
        key = (at_doc[i] * names + a) * names + b
        often = repeated(key)
        if not len(often):
            break
        i, key = i[often], key[often]
        group = np.cumsum(np.append(False, key[1:] != key[:-1]))
        count = np.bincount(group)
        score = np.zeros(len(symbol) + 2, np.int64)  # at 1 + place; more frequent, then earlier keys first
        order = np.empty(len(count), np.int64)
        order[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count), 0, -1)
        score[i + 1] = order[group]
        best = (score[i + 1] > score[i]) & (score[i + 1] > score[i + 2])
        used = np.bincount(group[best], minlength=len(count))
        best &= used[group] > 1
        chosen, group = i[best], group[best]
        number = np.cumsum(used > 1) - 1
        made.append(np.stack([number[group] + names, start[chosen], end[chosen], end[chosen + 1]]))
        live = np.zeros(len(symbol), bool)
        live[i] = True
        live[chosen] = True
        symbol[chosen] = number[group] + names
        end[chosen] = end[chosen + 1]
        live[np.maximum(chosen - 1, 0)] = True
        live[chosen + 1] = False
        keep = np.ones(len(symbol), bool)
        keep[chosen + 1] = False
        names += int(number[-1]) + 1
        busy = np.zeros(int(at_doc[-1]) + 1, bool)
        busy[at_doc[i]] = True
        on = busy[at_doc]
        if on.sum() < 0.8 * len(on):  # documents without pairs are done
            done.append(np.stack([start[keep & ~on], end[keep & ~on], at_doc[keep & ~on]]))
            keep &= on
        symbol, start, end, at_doc, live = symbol[keep], start[keep], end[keep], at_doc[keep], live[keep]
    done.append(np.stack([start, end, at_doc]))
    rule, begin, mid, stop = np.concatenate(made, axis=1) if made else np.zeros((4, 0), np.int64)
    rest = np.concatenate(done, axis=1)
    rest = rest[:, np.argsort(rest[0], kind="stable")]
    return {"rule": rule, "start": begin, "mid": mid, "end": stop}, {"start": rest[0], "end": rest[1], "doc": rest[2]}


def halved(rest: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, mid, end) of the nodes of a balanced tree over what remains of each document."""
    start, end, doc, out = rest["start"], rest["end"], rest["doc"], []
    while True:
        first = np.maximum.accumulate(np.where(np.append(True, doc[1:] != doc[:-1]), np.arange(len(doc)), 0)) if len(doc) else doc
        left = np.flatnonzero(((np.arange(len(doc)) - first) % 2 == 0)[:-1] & (doc[1:] == doc[:-1])) if len(doc) else doc
        if not len(left):
            break
        out.append(np.stack([start[left], start[left + 1], end[left + 1]]))
        end = end.copy()
        end[left] = end[left + 1]
        keep = np.ones(len(doc), bool)
        keep[left + 1] = False
        start, end, doc = start[keep], end[keep], doc[keep]
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


class Extensions:
    """How far two places agree, forwards and backwards: names of all stretches of 1, 2, 4, ... words, equal if these are."""

    def __init__(self, words: np.ndarray, longest: int):
        self.names = [words]
        while 2 << len(self.names) - 1 <= longest:
            x, half = self.names[-1], 1 << len(self.names) - 1
            self.names.append(np.unique(x[:-half] * (int(x.max()) + 1) + x[half:], return_inverse=True)[1])

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            use = np.flatnonzero(out + (1 << k) <= most)
            out[use] += (self.names[k][x[use] + out[use]] == self.names[k][y[use] + out[use]]).astype(np.int64) << k
        return out

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of what ends before x and y."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            use = np.flatnonzero(out + (1 << k) <= most)
            at = out[use] + (1 << k)
            out[use] += (self.names[k][x[use] - at] == self.names[k][y[use] - at]).astype(np.int64) << k
        return out


def crossing(words: np.ndarray, doc: np.ndarray, nodes: tuple[np.ndarray, np.ndarray, np.ndarray], step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs within each node that cross its boundary, maximal in the node.

    A run of period q matches itself q words on in max(q, 12 - q) places or more, so in six at least; and of a run that
    crosses mid, the q words before mid or those from mid on are in it. So the six words at one of six places about mid
    (of those matches) stand again q words before or after, and only such periods are tried.
    """
    low, mid, high = nodes
    mixed = words.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    hashed = doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    n = len(words) - GRAM + 1
    if n < 1 or not len(low):
        return (np.zeros(0, np.int64),) * 4
    hashed = hashed[:n].copy()
    for j in range(GRAM):
        hashed = (hashed ^ mixed[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        hashed ^= hashed >> np.uint64(28)
    whole = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    again = whole[repeated(hashed[whole].view(np.int64))]
    if not len(again):
        return (np.zeros(0, np.int64),) * 4
    group = np.cumsum(np.append(False, hashed[again][1:] != hashed[again][:-1]))
    place = group * len(words) + again  # ascending
    rank = np.full(len(words), -1)
    rank[again] = np.arange(len(again))
    found = []
    near = np.append(0, np.cumsum(rank >= 0))
    use = np.flatnonzero(near[np.minimum(mid + 1, len(words))] > near[np.maximum(mid - GRAM, 0)])
    for left in (True, False):
        for j in range(GRAM):
            p = mid[use] - j if left else mid[use] - 1 - j
            ok = p >= low[use]
            ok[ok] = rank[p[ok]] >= 0
            node, p = use[ok], p[ok]
            r, g = rank[p], group[rank[p]]
            a = np.searchsorted(place, g * len(words) + low[node]) if left else r + 1
            b = r if left else np.searchsorted(place, g * len(words) + high[node] - GRAM, "right")
            count = np.maximum(b - a, 0)
            for at in np.split(np.arange(len(node)), np.searchsorted(np.cumsum(count), np.arange(step, int(count.sum()) + step, step))):
                of, other = expanded(a[at], count[at])
                v, q = node[at][of], np.abs(p[at][of] - again[other])
                m = mid[v]
                fits = (m - q >= low[v]) & (m < high[v]) if left else (m + q <= high[v]) & (m > low[v])
                v, q, m = v[fits], q[fits], m[fits]
                same = words[m - q] == words[m] if left else words[m - 1] == words[m - 1 + q]
                found.append(np.unique((v[same] * 2 + left) * (len(words) + 1) + q[same]))
    tried = np.unique(np.concatenate(found))
    q, v = tried % (len(words) + 1), tried // (len(words) + 1) // 2
    left = tried // (len(words) + 1) % 2 == 1
    if not len(v):
        return (np.zeros(0, np.int64),) * 4
    # extensions are needed in documents with such periods only
    some = np.zeros(int(doc[-1]) + 1, bool)
    some[doc[low[v]]] = True
    kept = some[doc]
    moved = np.cumsum(kept) - 1
    sizes = np.bincount(doc[kept])
    tell = Extensions(np.unique(words[kept], return_inverse=True)[1], int(sizes.max()))
    lo, m, hi = moved[low[v]], moved[mid[v]], moved[high[v] - 1] + 1
    x, y = np.where(left, m - q, m), np.where(left, m, m + q)
    ahead, behind = tell.forward(x, y, hi - y), tell.backward(x, y, x - lo)
    start, end = x - behind, y + ahead
    ok = (end - start >= np.maximum(LEAST, 2 * q)) & (start < m) & (end > m)
    v, q, start, end = v[ok], q[ok], start[ok], end[ok]
    shift = low[v] - moved[low[v]]
    order = np.lexsort((q, end, start, v))  # multiples of a period have its run
    v, q, start, end, shift = v[order], q[order], start[order], end[order], shift[order]
    new = np.append(True, (v[1:] != v[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(v)]
    return v[new], (start + shift)[new], (end + shift)[new], q[new]


def runs_of(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all documents, by start, then period; places in words.

    Every run is found whole at the lowest node of its document's derivation that holds it, whose boundary it crosses. Nodes
    that hold only a part of it find that part, with the same period, which falls away when intervals are merged. What a
    symbol has is worked out at its first occurrence and moved to all others.
    """
    made, rest = repair(words, doc)
    order = np.lexsort((made["start"], made["rule"]))
    rule, start = made["rule"][order], made["start"][order]
    first = np.flatnonzero(np.append(True, rule[1:] != rule[:-1])[: len(rule)])
    uses = np.diff(np.append(first, len(rule)))
    tree = halved(rest)
    low, mid, high = (np.concatenate([made[c][order][first], t]) for c, t in zip(("start", "mid", "end"), tree, strict=True))
    large = np.flatnonzero(high - low >= LEAST)
    v, begin, end, q = crossing(words, doc, (low[large], mid[large], high[large]))
    v = large[v]
    of, use = expanded(np.append(first, np.zeros(len(tree[0]), np.int64))[v], np.append(uses, np.ones(len(tree[0]), np.int64))[v])
    moved = np.where(v[of] < len(first), start[use] if len(start) else 0, low[v[of]]) - low[v[of]]
    begin, end, q = begin[of] + moved, end[of] + moved, q[of]
    order = np.lexsort((-end, begin, q))
    begin, end, q = begin[order], end[order], q[order]
    reach = np.maximum.accumulate(q * (len(words) + 1) + end) if len(q) else q
    whole = np.append(True, reach[:-1] < (q * (len(words) + 1) + end)[1:])[: len(q)]
    begin, end, q = begin[whole], end[whole], q[whole]
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def of_texts(texts: list[bytes]) -> tuple[list[list[dict]], list[bytes], list[int]]:
    """For each text: its runs, what is left when words are dropped, the number of words."""
    split = [t.split() for t in texts]  # of bytes: at the six white-space characters of ASCII
    sizes = np.array([len(w) for w in split], np.int64)
    runs, left = [[] for _ in texts], [b" ".join(w) for w in split]
    use = np.flatnonzero(sizes >= LEAST)
    ids = Ids()
    n = sizes[use]
    words = np.fromiter((ids[w] for k in use.tolist() for w in split[k]), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(use)), n)
    start, end, q = runs_of(words, doc)
    first = np.cumsum(n) - n
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + q, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge[:-1]) == 0
    of = doc[start] if len(start) else start
    for d, s, e, p in zip(of.tolist(), (start - first[of]).tolist(), (end - first[of]).tolist(), q.tolist(), strict=True):
        runs[use[d]].append({"start": s, "length": e - s, "period": p})
    for d in np.unique(of).tolist():
        stay = kept[first[d] : first[d] + n[d]]
        left[use[d]] = b" ".join(np.array(split[use[d]], object)[stay].tolist())
    return runs, left, sizes.tolist()


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed) for each row of docs.

    Words are what white space of ASCII divides. A run is a stretch of words of least period q that is 12 words and 2 q long
    or more and isn't part of a longer one of that period: start, length and period count words, from 0 on; by start, then
    period. collapsed: the words, one space between, without those that any run has after its first q words. Null texts
    have no words; rows keep their partition and nothing is shuffled; other columns are not read; empty docs give no rows.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for to in cuts(batch.column("text"), 4 << 20):
                part = batch.slice(at, to - at)
                at = to
                runs, left, n = of_texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(runs, kinds), pa.array(left, pa.binary())], ["id", "n_words", "runs", "collapsed"])

    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(run, f"id {kind}, n_words bigint, runs {RUNS}, collapsed binary")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one document of ten, by the CRC-32 of its id, the words from a on repeat those from a to a + p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    held = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", SPACES), lambda w: w != "")).alias("w"))
    cut = held.withColumn("n", F.size("w")).withColumn("a", F.expr("CASE WHEN n > 0 THEN int((h div 10) % n) END"))
    cut = cut.withColumn("p", F.expr("int(1 + (n - a) div (3 + (h div 10) % 8))"))
    tail = F.expr("flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p + 1)))")
    text = F.array_join(F.slice(F.concat(F.expr("slice(w, 1, a)"), tail), F.lit(1), F.col("n")), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", (-F.col("b.less")).alias("length"), "b.period", F.expr("1000 * -b.less div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL = {
    "op11_periodic_runs": """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h
  FROM documents, crc),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
word AS (
  SELECT r, i, w[CASE WHEN i >= a THEN a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) ELSE i END + 1] AS x
  FROM (SELECT *, unnest(range(len(w))) AS i FROM p)),
pair AS (SELECT m.r, n.i - m.i AS q, m.i FROM word m JOIN word n ON n.r = m.r AND n.x = m.x AND n.i > m.i),
island AS (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pair) GROUP BY r, q, g HAVING count(*) >= greatest(q, 12 - q)),
run AS (SELECT r, s, e, min(q) AS q FROM island GROUP BY ALL),
summed AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256, min({'l': s - e, 's': s, 'q': q}) AS b
  FROM run GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.r = word.r AND i >= s + q AND i < e) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.q AS period, 1000 * -b.l // b.q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN summed USING (r) LEFT JOIN kept USING (r)"""
}
