"""Scalar rules of the audit: severities, confidences, categories, names, versions. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities and confidences from the lowest up, and their weights.
SEVERITIES = ("Informational", "Low", "Medium", "High", "Critical")
SEVERITY_WEIGHTS = (0, 1, 10, 100, 1000)
CONFIDENCES = ("Low", "Medium", "High")
CONFIDENCE_WEIGHTS = (1, 5, 10)
CONFIDENCE_SCORES = (0.3, 0.6, 0.9)
#: Categories in order, by what the detector's id contains.
CATEGORIES = (("reentrancy", "reentrancy"), ("access", "access-control"), ("unchecked", "unchecked"), ("dangerous", "dangerous"), ("delegatecall", "dangerous"), ("dos", "dos"), ("overflow", "overflow"), ("underflow", "overflow"), ("time", "time"))
#: Beginnings of contract names that aren't scanned.
SKIPPED = ("Attack", "Exploit", "Test", "Mock", "Secure", "Fixed", "Safe", "Example")


def pick(value: Column, names: tuple, results: tuple) -> Column:
    out = F.when(value == names[0], F.lit(results[0]))
    for n, r in zip(names[1:], results[1:], strict=True):
        out = out.when(value == n, F.lit(r))
    return out


def severity_rank(severity: Column) -> Column:
    return pick(severity, SEVERITIES, tuple(range(5)))


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank.cast("int"))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")


def priority(severity: Column, confidence: Column) -> Column:
    return (pick(severity, SEVERITIES, SEVERITY_WEIGHTS) * pick(confidence, CONFIDENCES, CONFIDENCE_WEIGHTS)).cast("long")


def category(scanner_id: Column) -> Column:
    out = F.when(scanner_id.contains(CATEGORIES[0][0]), CATEGORIES[0][1])
    for part, name in CATEGORIES[1:]:
        out = out.when(scanner_id.contains(part), name)
    return out.otherwise(F.substring_index(scanner_id, "-", 1))


def skipped_contract(name: Column) -> Column:
    return name.rlike(f"^({'|'.join(SKIPPED)})|Example$")


def same_function(a: Column, b: Column) -> Column:
    """b is a, or a with a suffix of its types."""
    return (a == b) | (b.startswith(a) & F.substr(b, F.length(a) + 1).rlike(r"^_[\p{L}\p{N}_]*$"))


def suppressed(score: Column, name: Column, finding_type: Column, severity: Column, confidence: Column) -> Column:
    """Whether a finding isn't worth a report: too unsure, or about a getter, a constructor or a token's views."""
    low = F.lower(name)
    getter = low.rlike("^(get|has|can|check)") | (low.startswith("is") & ((finding_type != "simple-timestamp") | (severity_rank(severity) < 3)))
    view = (low.contains("balance") & low.contains("of")) | low.contains("allowance") | low.isin("decimals", "symbol", "name", "totalsupply", "owner")
    return (score < 0.3) | (name == "constructor") | name.contains("Constructor") | getter | view | ((severity == "Informational") & (confidence == "Low"))


def version(source: Column) -> Column:
    """(major, minor, patch) of the first pragma; null without one. Structs compare as versions do."""
    text = F.regexp_extract(source, r"pragma\s+solidity\s+([^;]*);", 1)
    first = F.get(F.split(F.trim(F.regexp_replace(text, r"[\^~<>=]+", " ")), r"\s+"), F.lit(0))
    part = lambda i: F.coalesce(F.get(F.split(first, r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(text != "", F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


def adjusted_severity(base: Column, contract: Column, visibility: Column, scanner_id: Column, description: Column) -> Column:
    """Four rules in order: contracts of value and public functions raise, a plain reentrancy of withdrawals is critical,
    what is never used falls."""
    up = lambda r, on: F.when(on, F.least(r + 1, F.lit(4))).otherwise(r)
    rank = up(severity_rank(base), contract.rlike("Token|Vault"))
    rank = up(rank, ~visibility.rlike("internal|private"))
    rank = F.when((scanner_id == "reentrancy-simple") & description.rlike("withdraw|transfer"), F.lit(4)).otherwise(rank)
    rank = F.when(description.rlike("never used|unused"), F.greatest(rank - 1, F.lit(0))).otherwise(rank)
    return severity_name(rank)


def reentrancy_confidence(several: Column, critical: Column, guarded: Column, protected: Column, test_like: Column) -> Column:
    """Single-precision score, clamped to 0..1."""
    f = lambda x: F.lit(x).cast("float")
    add = lambda s, on, x: F.when(on, s + f(x)).otherwise(s)
    s = add(add(f(0.7), several, 0.1), critical, 0.1)
    s = add(s, protected | guarded, -0.4)
    s = F.when(guarded, F.least(s, f(0.2))).otherwise(s)
    return F.greatest(f(0.0), F.least(f(1.0), add(s, test_like, -0.3)))


def _scored(base: float, *changes: tuple[Column, float]) -> Column:
    """A single-precision score of a base and what conditions add to it, clamped to 0..1."""
    s = F.lit(base).cast("float")
    for on, x in changes:
        s = F.when(on, s + F.lit(x).cast("float")).otherwise(s)
    return F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), s))


def access_confidence(several: Column, critical: Column, modified: Column, checked: Column, view: Column, test_like: Column) -> Column:
    return _scored(0.7, (several, 0.1), (critical, 0.2), (modified, -0.5), (checked, -0.4), (view, -0.3), (test_like, -0.3))


def unchecked_confidence(critical: Column, safe_library: Column, handled: Column, test_like: Column) -> Column:
    return _scored(0.8, (critical, 0.1), (safe_library, -0.5), (handled, -0.3), (test_like, -0.2))


def test_like(name: Column) -> Column:
    low = F.lower(name)
    return low.startswith("test") | low.contains("_test_") | low.contains("example")
