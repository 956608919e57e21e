"""The scan end to end: sources, facts, detectors, filters, deduplication, order, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import detectors as D
from ..operators import findings as P
from ..operators.facts import Facts, contracts

#: libraries' functions that check results themselves, modifiers that guard, operations that move control.
SAFE_CALLS = ("safeTransfer", "safeTransferFrom", "safeApprove", "safeIncreaseAllowance", "safeDecreaseAllowance")
GUARDS = ("onlyOwner", "onlyAdmin", "onlyRole", "onlyMinter", "onlyGovernance", "whenNotPaused", "nonReentrant", "initializer")
FIRST_CALLS = ("call{", ".call(", ".transfer(", ".send(")


def listed(spark: SparkSession) -> DataFrame:
    """The registry as a table: id, severity, confidence, enabled."""
    return spark.createDataFrame([(x.id, x.severity, x.confidence, x.enabled) for x in D.DETECTORS], "id string, severity string, confidence string, enabled boolean")


def selected(ids: Iterable[str] | None = None, least_severity: str | None = None, every: bool = False) -> list[D.Detector]:
    """Detectors by id, by their least severity, and unless `every`, those enabled."""
    out = [x for x in D.DETECTORS if (ids is None and (every or x.enabled)) or (ids is not None and x.id in set(ids))]
    return [x for x in out if least_severity is None or rules.SEVERITIES.index(x.severity) >= rules.SEVERITIES.index(least_severity)]


def detected(facts: Facts, chosen: Iterable[D.Detector], failed: list[tuple[str, str]] | None = None) -> DataFrame:
    """All findings of the detectors, with `ord`. A detector whose plan fails is left out and, if `failed` is given, named there."""
    parts = []
    for x in chosen:
        try:
            parts.append(x.run(facts).select(*D.COLUMNS))
        except (PySparkException, ValueError) as e:
            if failed is None:
                raise
            failed.append((x.id, str(e)))
    if not parts:
        return facts.sources.sparkSession.createDataFrame([], "scanner_id string, finding_type string, severity string, confidence string, score double, title string, file string, contract string, function string, line long, end_line long, snippet string, ord long")
    return D.union(parts).withColumn("ord", F.xxhash64("scanner_id", "finding_type", "file", "contract", "function", "line", "snippet"))


def composite(parts: list[DataFrame]) -> DataFrame:
    """Several detectors as one: each place once, with the greatest severity and the least confidence of those that report it."""
    rank = lambda c, names: rules.pick(F.col(c), names, tuple(range(len(names))))
    name = lambda c, names: F.get(F.array(*map(F.lit, names)), c)
    both = D.union(parts).groupBy("file", "contract", "function", "line").agg(F.max(rank("severity", rules.SEVERITIES)).alias("s"), F.min(rank("confidence", rules.CONFIDENCES)).alias("c"), F.array_sort(F.collect_set("scanner_id")).alias("scanners"))
    return both.select("file", "contract", "function", "line", name(F.col("s"), rules.SEVERITIES).alias("severity"), name(F.col("c"), rules.CONFIDENCES).alias("confidence"), "scanners")


def sequential(facts: Facts, chosen: Iterable[D.Detector], stop: Callable[[DataFrame], bool]) -> DataFrame:
    """Detectors one after another until stop(findings so far) holds."""
    out = None
    for x in chosen:
        new = x.run(facts).select(*D.COLUMNS)
        out = new if out is None else out.unionByName(new)
        if stop(out):
            break
    return out


def filtered(found: DataFrame, keep: Column) -> DataFrame:
    return found.where(keep)


def effects_before_calls(text: Column) -> Column:
    """Whether a line before the first call assigns to state (any such line will do)."""
    first = F.array_min(F.filter(F.array(*(F.locate(c, text) for c in FIRST_CALLS)), lambda x: x > 0))
    lines = F.transform(F.split(F.substr(text, F.lit(1), first - 1), "\n"), lambda x: F.trim(x))

    def writes(x: Column) -> Column:
        left = F.trim(F.substring_index(x, "=", 1))
        declares = x.rlike("^(uint |address |bool |bytes|string |int |mapping|//)") | (x == "")
        assigns = x.contains("=") & ~x.contains("==") & ~x.contains("!=") & ~x.contains("=>")
        return ~declares & assigns & ((left.contains("[") & left.contains("]")) | (left.contains(".") & ~left.rlike(r"^(msg|tx|block)\.")) | (~left.contains(" ") & ~left.contains("(")))

    return F.coalesce(first.isNotNull() & F.exists(lines, writes), F.lit(False))


def known_safe(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings without those that the source near them shows to be safe: guarded or ordered calls, checking libraries, guarding modifiers."""
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    f = found.join(sources.select("file", "content"), "file", "left")
    at = F.position(F.concat(F.lit("function "), F.col("function")), F.col("content"))
    window = lambda n: F.when(at > 0, F.substr("content", at, F.lit(n)))
    line = F.get(F.split("content", "\n"), (F.col("line") - 1).cast("int"))
    reentrancy = F.coalesce(window(500).contains("nonReentrant") | effects_before_calls(window(500)), F.lit(False))
    unchecked = has(line, SAFE_CALLS) | (line.contains(".transfer(") & ~line.contains(".send(") & (line.contains("payable") | line.contains("{value:")))
    head = F.when(window(200).contains("{"), F.substring_index(window(200), "{", 1))
    access = has(head, GUARDS) | (head.contains("require") & head.contains("msg.sender"))
    id_ = F.col("scanner_id")
    safe = F.when(id_.contains("reentrancy"), reentrancy).when(id_.contains("unchecked") & id_.contains("return"), unchecked).when(id_.contains("access"), access).otherwise(F.lit(False))
    return f.where(~F.coalesce(safe, F.lit(False))).drop("content")


def scan(sources: DataFrame, *, ids: Iterable[str] | None = None, every: bool = False, least_score: float = 0.6, failed: list | None = None) -> DataFrame:
    """Findings of sources (file, content): contracts that are examples or tests are left out, then unsure findings, those not
    worth a report and those known to be safe; of what is near each other one is kept. With priority; sort by ordered()."""
    facts = Facts(sources.where("content IS NOT NULL"), keep=("functions", "loops"))
    found = detected(facts, selected(ids, every=every), failed).where(~rules.skipped_contract(F.col("contract"))).where(F.col("score") >= least_score)
    found = found.where(~rules.suppressed(F.col("score"), F.col("function"), F.col("finding_type"), F.col("severity"), F.col("confidence")))
    return P.deduplicated(known_safe(found, sources))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("priority"), "file", "line", "ord")


def files(sources: DataFrame) -> DataFrame:
    """(file, status, contracts): what a directory scan reports of each file; unreadable or without a contract: its status."""
    known = contracts(Facts(sources.where("content IS NOT NULL")).parts).groupBy("file").agg(F.count(F.lit(1)).alias("contracts"))
    status = F.when(F.col("content").isNull(), "unreadable").when(F.coalesce("contracts", F.lit(0)) == 0, "no contract").otherwise("ok")
    return sources.join(known, "file", "left").select("file", status.alias("status"), F.coalesce("contracts", F.lit(0)).alias("contracts"))
