"""Mixing sources to target weights: Pfair windows for each source's blocks, interleaved by earliest deadline first."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_hash, stored, table


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))  # null is a source of its own


def shares(counts: DataFrame, weights: DataFrame | None, period: int) -> DataFrame:
    """(src, n, units): integer units that sum to `period`, one at least, by largest remainders of the target weights.

    counts: (src, n). weights: (src, weight) of whole numbers, 0 or more; none: the whole square root of n.
    """
    w = counts.withColumn("weight", F.floor(F.sqrt("n"))) if weights is None else counts.join(weights, "src", "left").fillna(0, ["weight"])
    every = Window.partitionBy(F.lit(0))  # a row for each source
    w = w.withColumn("free", F.lit(period) - F.count(F.lit(1)).over(every)).withColumn("all", F.greatest(F.sum("weight").over(every), F.lit(1)))
    w = w.withColumn("whole", F.expr("1 + (weight * free) div all")).withColumn("rest", F.expr("(weight * free) % all"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "src"))
    return w.withColumn("units", (F.col("whole") + (place <= F.lit(period) - F.sum("whole").over(every)).cast("int")).cast("long")).select("src", "n", "units")


def schedule(parts: DataFrame, period: int) -> DataFrame:
    """One period of slots: (src, turn, slot), a row for each; parts: (src, units), the units sum to the period.

    Block k = 0, 1, ... of a source of u units has release floor(k * period / u) and deadline ceil((k + 1) * period / u).
    Each slot goes to the released block of the earliest deadline, ties by source. As the units sum to the period, every
    slot is filled, every deadline met, and no source strays a whole block from its share; windows repeat after a period.
    The blocks that are released and not yet placed are an array of numbers (deadline, then source), one for each source at
    most, and a slot takes the least: period times sources steps on plain numbers.
    """
    n = parts.count()
    named = parts.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src")).cast("long") - 1)
    blocks = named.select("i", "units", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("k"))
    blocks = blocks.select(F.expr(f"k * {period} div units").alias("slot"), (F.expr(f"((k + 1) * {period} + units - 1) div units") * F.lit(n) + F.col("i")).alias("code"))
    slots = parts.sparkSession.range(period).select(F.col("id").alias("slot"))
    released = slots.join(blocks.groupBy("slot").agg(F.collect_list("code").alias("codes")), "slot", "left")
    one = released.agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes")))).alias("at"))

    def bound(x: Column, f) -> Column:
        """f of x, with x worked out once."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def step(acc: Column, at: Column) -> Column:
        take = lambda ready: bound(F.array_min(ready), lambda best: F.struct(F.concat(acc["out"], F.array(best)).alias("out"), F.array_remove(ready, best).alias("ready")))
        return bound(F.concat(acc["ready"], at["codes"]), take)

    start = F.expr("named_struct('out', cast(array() as array<bigint>), 'ready', cast(array() as array<bigint>))")
    rows = one.select(F.posexplode(F.aggregate("at", start, step, lambda acc: acc["out"])).alias("slot", "code"))
    rows = rows.select(F.col("slot").cast("long").alias("slot"), F.expr(f"code % {n}").alias("i")).join(named.select("i", "src"), "i")
    return rows.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("slot")).cast("long") - 1).alias("turn"), "slot")


def mixed(docs: DataFrame, *, weights: dict[str | None, int] | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = 8, period: int = 1000, name: str = "position") -> DataFrame:
    """docs with a column `name`: each row's place, from 0 on, in a mixture of the sources at their target weights.

    A source's rows, in the order of md5(id) (then id, then a hash of the row), form blocks of `block` rows. Blocks go to
    slots by Pfair windows (see schedule()), so that while every source lasts, each has had its share of any beginning to
    within one block. A source that runs out leaves its slots to nobody: they close up, and the rest keep their
    proportions. Every row appears once. weights: whole numbers by source; sources not named get one unit a period; none:
    the whole square root of their rows. The period is `period` slots, or four for each source if these are more.

    Rows are ranked within ranges of md5(id), whose number grows with the largest source, and placed within one turn of the
    period, so no task holds a source; the schedule is a row for each slot of a period and joined by (source, turn). Null
    sources are a source of their own, null ids come first in it; repeated rows get places of their own; empty docs give no
    rows.
    """
    spark = docs.sparkSession
    cols = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(cols)))
    source, doc = F.col(f"_{cols.index(source_col)}"), F.col(f"_{cols.index(id_col)}")
    keyed = plain.withColumn("src", _key(source)).withColumn("h", F.coalesce(F.md5(doc.cast("string")), F.lit("")))
    counts = stored(keyed.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "sources")
    n_sources, largest = counts.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_sources:
        return docs.withColumn(name, F.lit(0).cast("long"))
    period = max(period, 4 * n_sources)
    digits = max(1, ceil(log(largest / 200, 16))) if largest else 1  # ranges of about 200 rows at most
    wanted = None if weights is None else spark.createDataFrame([("" if k is None else f"={k}", int(w)) for k, w in weights.items()], "src string, weight long")
    parts = stored(shares(counts, wanted, period), "shares")
    plan = stored(schedule(parts.select("src", "units"), period), "schedule")
    keyed = keyed.withColumn("bucket", F.substring("h", 1, digits))
    offsets = keyed.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    offsets = offsets.withColumn("offset", F.sum("rows").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).join(parts.select("src", "units"), "src")
    inner = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", doc, row_hash(plain)))
    ranked = keyed.withColumn("inner", inner).join(offsets.select("src", "bucket", "offset", "units"), ["src", "bucket"])
    ranked = ranked.withColumn("rank", F.coalesce("offset", F.lit(0)) + F.col("inner") - 1).withColumn("k", F.expr(f"rank div {block}"))
    at = ranked.withColumn("turn", F.expr("k % units")).withColumn("round", F.expr("k div units")).join(plan, ["src", "turn"])
    # rows before a round: sums over thousands of rounds, then over the rounds of one thousand, so that no window holds all
    rounds = at.groupBy("round").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.expr("round div 4096"))
    upto = lambda *by: F.coalesce(F.sum("rows").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = rounds.groupBy("part").agg(F.sum("rows").alias("rows")).select("part", upto(F.lit(0), "part").alias("parts_before"))
    before = rounds.withColumn("inside", upto("part", "round")).join(whole, "part").select("round", (F.col("inside") + F.col("parts_before")).alias("before"))
    placed = at.withColumn("in_round", F.row_number().over(Window.partitionBy("round").orderBy("slot", "rank"))).join(before, "round")
    return placed.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(cols)), (F.col("before") + F.col("in_round") - 1).alias(name))


def with_places(docs: DataFrame, name: str, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """As mixed(), for rows with long texts: places are worked out on ids, sources and hashes of the rows, and the other
    columns move once, to meet them."""
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)))
    doc, source = f"_{docs.columns.index(id_col)}", f"_{docs.columns.index(source_col)}"
    tagged = plain.withColumns({"tag": row_hash(plain), "tag2": F.xxhash64(row_hash(plain, 7), F.col(doc))})  # 128 bits tell rows apart
    places = stored(mixed(tagged.select(doc, source, "tag", "tag2"), source_col=source, id_col=doc, name="place", **options).select("tag", "tag2", "place"), "places")
    # rows alike in every column are one here, and again one for each of their places; grouped and joined by one exchange
    rows = tagged.groupBy("tag", "tag2").agg(*(F.first(c).alias(c) for c in plain.columns)).join(places, ["tag", "tag2"])
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("place").alias(name))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """docs as a mixture: rows dealt to partitions by ranges of their place and sorted within, so that the files of a
    written table hold the mixture in order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = next(x for x in (f"place{i or ''}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    return with_places(docs, place, **options).repartitionByRange(n, place).sortWithinPartitions(place).drop(place)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {"op10_mixture": op10_mixture}
ORACLE_SQL = {
    "op10_mixture": """
WITH RECURSIVE c AS (SELECT coalesce('=' || source, '') AS src, count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS weight FROM documents GROUP BY ALL),
w AS (SELECT *, greatest(1000, 4 * count(*) OVER ()) AS per, greatest(1000, 4 * count(*) OVER ()) - count(*) OVER () AS free, CAST(sum(weight) OVER () AS BIGINT) AS every FROM c),
v AS (SELECT *, 1 + (weight * free) // every AS whole, row_number() OVER (ORDER BY (weight * free) % every DESC, src) AS place, row_number() OVER (ORDER BY src) AS i FROM w),
u AS (SELECT src, i, n, per, CAST(whole + CASE WHEN place <= per - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS units FROM v),
a AS (SELECT list(units ORDER BY i) AS us, max(per) AS per FROM u),
s AS (
  SELECT 0 AS slot, list_transform(us, lambda x: 0) AS done, us, per, CAST(NULL AS BIGINT) AS pick FROM a
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), us, per, p
  FROM (SELECT *, list_sort(list_transform(us, lambda x, i: {'d': CASE WHEN (done[i] * per) // x <= slot THEN ((done[i] + 1) * per + x - 1) // x ELSE 1000000000 END, 'i': i}))[1].i AS p FROM s WHERE slot < per)),
slots AS (SELECT slot - 1 AS slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM s WHERE slot > 0),
r AS (SELECT doc_id, source, u.i, u.units, row_number() OVER (PARTITION BY u.src ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS rank FROM documents JOIN u ON u.src = coalesce('=' || source, '')),
b AS (SELECT r.*, (rank // 8) // units * per + slot AS t FROM (SELECT r.*, per FROM r, a) r JOIN slots ON slots.i = r.i AND slots.turn = (rank // 8) % units)
SELECT doc_id, source, CAST(row_number() OVER (ORDER BY t, rank) - 1 AS BIGINT) AS position FROM b"""
}
