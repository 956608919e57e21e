"""Helpers shared by the operators of this subpackage: tables, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a local master only, a new temporary one where unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here and lost executors lose nothing.

    What was shuffled for it is of no more use then, and Spark is told to delete it when the write ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of stored(), when nothing that is still to be worked out reads it."""
    store, path = fs.FileSystem.from_uri(df.stored_at)
    store.delete_dir(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other code point left alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns; what can't be hashed (maps, variants) by its text."""
    plain = lambda t: not any(x in t for x in ("map<", "variant", "geo"))
    return F.xxhash64(F.lit(seed), *(F.col(f"`{f.name}`") if plain(f.dataType.simpleString()) else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields))


def components(edges: DataFrame, max_rounds: int = 40, tidy: bool = False) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a, b) of any one ordered type, in either direction, repeats and loops allowed. Returns (node, component)
    for each node that has an edge to another; component is its smallest reachable node. Each round is two grouped
    minima and two joins, so a hub's edges are pre-aggregated or split by the skew-join rule and never gathered; the
    edges of each round are written to the shared folder, and with tidy, deleted when the next round's are; the last ones are
    the result's, as `edges`. Raises if max_rounds doesn't settle it.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    was = mark(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if tidy:
            discard(before)
        if (new := mark(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds; give more by max_rounds")
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = leaf.unionByName(leaf.select(F.col("component").alias("node"), "component").distinct())
    out.edges = now
    return out
