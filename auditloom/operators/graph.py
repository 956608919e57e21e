"""Call graphs and control flow as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def depths(edges: DataFrame, roots: DataFrame, step=lambda df: written(df, "depths")) -> DataFrame:
    """(root, node, depth): the fewest edges (src, dst) from each root (root) to all it reaches, itself at 0.

    Breadth first: each round joins the last round's new nodes alone with the edges and drops those seen before, until there
    are none. step writes a round's rows, so that no round is worked out again by the next.
    """
    edges = step(edges.select("src", "dst").distinct())
    seen = step(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    last, d = seen, 0
    while True:
        d += 1
        new = last.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        last = step(new.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if last.isEmpty():
            return seen
        seen = seen.unionByName(last)


def loops(edges: DataFrame, by: list[str], step=lambda df: written(df, "loops")) -> DataFrame:
    """(by, header, body, exits) of the natural loops of flows: edges (by, src, dst), where one that doesn't go forward closes a loop.

    A body is what reaches the tail of such an edge without passing the header; exits are where edges leave it.
    """
    edges = step(edges.select(*by, "src", "dst").distinct())
    back = edges.where("dst <= src").select(*by, F.col("dst").alias("header"), F.col("src").alias("x"))
    seen = step(back.unionByName(back.select(*by, "header", F.col("header").alias("x"))).distinct())
    last = seen
    while True:
        new = last.where("x <> header").join(edges.withColumnRenamed("dst", "x"), [*by, "x"]).select(*by, "header", F.col("src").alias("x")).distinct()
        last = step(new.join(seen, [*by, "header", "x"], "left_anti"))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    seen = step(seen)
    out = seen.join(edges.withColumnRenamed("src", "x"), [*by, "x"]).select(*by, "header", F.col("dst").alias("x")).distinct().join(seen, [*by, "header", "x"], "left_anti")
    exits = out.groupBy(*by, "header").agg(F.array_sort(F.collect_set("x")).alias("exits"))
    body = seen.groupBy(*by, "header").agg(F.array_sort(F.collect_set("x")).alias("body"))
    return step(body.join(exits, [*by, "header"], "left")).withColumn("exits", F.coalesce("exits", F.array().cast(dict(body.dtypes)["body"])))


def writes_after(found: DataFrame, edges: DataFrame, writes: DataFrame, by: list[str], most: int = 10, step=lambda df: written(df, "after")) -> DataFrame:
    """Loops (by, header, exits) with the blocks that write (by, block) and lie within `most` edges of an exit. Each round's new
    blocks are a table, so that a task holds one round's joins."""
    key = [*by, "header", "block"]
    edges = step(edges.select(*by, F.col("src").alias("block"), "dst").distinct())
    last = near = step(found.select(*by, "header", F.explode("exits").alias("block")).distinct())
    for _ in range(most):
        last = step(last.join(edges, [*by, "block"]).select(*by, "header", F.col("dst").alias("block")).distinct().join(near, key, "left_anti"))
        if last.isEmpty():
            break
        near = near.unionByName(last)
    return near.join(writes, [*by, "block"], "left_semi").groupBy(*by, "header").agg(F.array_sort(F.collect_set("block")).alias("writes"))


def diverging(paths_: DataFrame, call: str = "call", write: str = "write") -> DataFrame:
    """Pairs of a path that calls and one from the same start that writes, with the block where they part: conditional reentrancy.
    paths_: (start, path, call, write), the blocks of the first call and write or null; paths of one start and first difference meet."""
    a = paths_.where(F.col(call).isNotNull()).select("start", F.col("path").alias("p"), call)
    b = paths_.where(F.col(write).isNotNull()).select("start", F.col("path").alias("q"), write)
    both = a.join(b, "start").where("p <> q")
    same = F.array_position(F.zip_with("p", "q", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return both.where(same > 1).select("start", call, write, F.get("p", (same - 2).cast("int")).alias("parts_at")).distinct()


def back_edges(edges: DataFrame) -> DataFrame:
    """Loop headers: targets of edges that don't go forward, with how many come in."""
    return edges.where("dst <= src").groupBy(F.col("dst").alias("header")).agg(F.count(F.lit(1)).alias("tails"), F.max("src").alias("last_tail"))


def paths(edges: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """Simple paths of up to `longest` edges from starts (node), as arrays; a path never meets a node twice."""
    now = starts.select(F.array("node").alias("path"))
    every = now
    for _ in range(longest):
        now = now.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        every = every.unionByName(now)
    return every


def components(edges: DataFrame, by: list[str], step=lambda df: written(df, "components")) -> DataFrame:
    """(by, node, component) for each node of the edges (by, a, b) that has one to another; component is its least reachable node.

    Two kinds of rounds take turns: larger neighbours go over to a node's least neighbour, then smaller ones. Both are a
    grouped minimum and a join; their number is about the logarithm of the longest path.
    """
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(20,0)"))).first())
    now = step(edges.where("a <> b").select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = mark(now)
    while True:
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = step(both.join(least, [*by, "u"]).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*by, "u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        new = step(small.unionByName(low.select(*by, "u", F.col("m").alias("v"))).distinct())
        before, was, now = was, mark(new), new
        if was == before:
            break
    leaf = now.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(leaf.select(*by, F.col("component").alias("node"), "component").distinct())
