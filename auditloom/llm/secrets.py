"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware control of false discoveries."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

# The contract's patterns. Runs of one class match whole, so their least lengths can stand in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
SPACE = re.compile(r"([a-z]) ([a-z])")
#: Alphabets by name; a candidate's encoding is the first whose alphabet holds it and all of whose classes it uses.
ENCODINGS = (
    ("hex", "0123456789abcdef", ("0-9", "a-f")),
    ("HEX", "0123456789ABCDEF", ("0-9", "A-F")),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ("A-Z", "2-7")),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ("A-Z", "a-z", "0-9")),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ("A-Z", "a-z", "0-9")),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", ("A-Z", "a-z", "0-9")),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", ("0-9", "a-z")),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("0-9", "A-Z")),
    ("lower", "abcdefghijklmnopqrstuvwxyz", ("a-z",)),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("A-Z",)),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ("A-Z", "a-z")),
    ("letters+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", ("A-Z", "a-z")),
    ("letters-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", ("A-Z", "a-z")),
)
WORDY = {"base36", "BASE36", "lower", "upper", "letters", "letters+/", "letters-_"}  # words and names can be these, too
# Weights of a to z: logarithm of about how many of a thousand letters of English, German, French and Spanish prose they are.
_LETTERS = np.log([85, 16, 32, 44, 152, 14, 18, 28, 74, 4, 5, 43, 28, 83, 60, 23, 6, 66, 70, 72, 38, 12, 10, 4, 8, 7])
_TESTED = [(name, {c: i for i, c in enumerate(alphabet)}, re.compile(f"[{re.escape(alphabet)}]+"), [re.compile(f"[{c}]") for c in classes]) for name, alphabet, classes in ENCODINGS]
P_BINS = 400  # of log10(p), 20 to the decade: p-values down to 1e-20


def encoding_of(s: str) -> tuple[str, np.ndarray, int] | None:
    """(name, digits, size of the alphabet) of the inferred encoding; padding is left out."""
    s = s.rstrip("=")
    for name, index, whole, classes in _TESTED:
        if whole.fullmatch(s) and all(c.search(s) for c in classes):
            return name, np.array([index[c] for c in s]), len(index)
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(x: np.ndarray, size: int) -> float:
    """Combined p-value of three tests of digits x being uniform and independent: chi-squared uniformity of the alphabet
    (cube-root normal form, both tails are not wanted: too even is no sign of a text), runs above and below the middle,
    serial correlation at lag one. Combined as three times the least, so that dependence between tests does no harm."""
    n = len(x)
    k = min(size, max(2, n // 5))  # groups of digits with five expected in each
    chi2 = float(((np.bincount(x * k // size, minlength=k) - (e := np.bincount(np.arange(size) * k // size, minlength=k) * n / size)) ** 2 / e).sum())
    z = ((chi2 / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    p_uniform = 0.5 * math.erfc(z / math.sqrt(2))
    up = x >= size / 2
    a, b = int(up.sum()), int(n - up.sum())
    if a and b:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = _normal_tail((1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    s = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / s if s else 1.0
    p_serial = _normal_tail((r + 1 / n) * math.sqrt(n)) if s else 2.0 ** (1 - n)
    return min(1.0, 3 * min(p_uniform, p_runs, p_serial))


def like_words(s: str) -> float:
    """p-value of the letters of s being uniform, against their being those of prose: their mean weight is too high."""
    x = np.array([ord(c) - 97 for c in s.lower() if "a" <= c <= "z"])
    if not len(x):
        return 1.0
    return 0.5 * math.erfc(float(_LETTERS[x].mean() - _LETTERS.mean()) / float(_LETTERS.std()) * math.sqrt(len(x) / 2))


_SHARE = np.exp(_LETTERS) / np.exp(_LETTERS).sum()
DIGITS = 0.1  # share of digits that names and words have at most
RANDOM = 0.01  # below this p-value of being random a string isn't
PRIOR = 2000.0  # pairs after each letter that stand for prose letters in any order, beside those counted
_FOLD = np.full(256, 26, np.uint8)  # bytes to 0-25 for letters of either case, 26 for others
_FOLD[97:123] = _FOLD[65:91] = np.arange(26)


class Prose:
    """How letters follow each other in the words of a corpus: the null against which strings are told from text.

    counts: 26 x 26 of letters after letters, in words and over one space (names are words run together). What is scored is
    the mean log probability of a string's letters after the ones before; mean and deviation of a pair's under the null follow from the
    same counts. Without counts a letter's probability is its share in prose, whatever comes before.
    """

    def __init__(self, counts: np.ndarray | None = None):
        n = np.zeros((26, 26)) if counts is None else np.asarray(counts, float).reshape(26, 26)
        after = (n + PRIOR * _SHARE) / (n.sum(1, keepdims=True) + PRIOR)
        first = n.sum(1) + PRIOR * _SHARE
        self.log = np.log(after)
        joint = after * (first / first.sum())[:, None]
        self.mean = float((joint * self.log).sum())
        self.deviation = float(math.sqrt((joint * self.log**2).sum() - self.mean**2))

    def p_text(self, s: str) -> float:
        """p-value of s being words: its letters follow each other so seldom in text. A step from a small to a capital letter begins a
        word and isn't scored; pairs of a text aren't independent, so that half of them count."""
        b = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
        x = _FOLD[b]
        ok = (x[:-1] < 26) & (x[1:] < 26) & ~((b[:-1] >= 97) & (b[1:] < 97))
        if not ok.any():
            return 1.0
        return 0.5 * math.erfc((self.mean - float(self.log[x[:-1][ok], x[1:][ok]].mean())) / self.deviation * math.sqrt(int(ok.sum()) / 2) / math.sqrt(2))


def pairs(text: str) -> np.ndarray:
    """Counts of letters after letters in a text, 26 x 26 in one row, without those in candidates."""
    b = _FOLD[np.frombuffer(SPACE.sub(r"\1\2", CANDIDATE.sub("  ", text)).encode("utf-8", "replace"), np.uint8)].astype(np.int64)
    return np.bincount(b[:-1] * 27 + b[1:], minlength=729).reshape(27, 27)[:26, :26].ravel()


def prose(docs: DataFrame, text_col: str = "text") -> Prose:
    """Counts over all texts; 676 sums come to the driver, whatever the corpus."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(676, np.int64)
        for batch in parts:
            for t in batch.column(0).to_pylist():
                total += pairs(t or "")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(676), pa.int32()), pa.array(total)], ["pair", "n"])

    rows = docs.select(text_col).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(676)
    for r in rows:
        counts[r["pair"]] = r["n"]
    return Prose(counts)


def randomness(s: str, name: str, x: np.ndarray, size: int) -> float:
    """p-value of s being random: the battery's, and for encodings that words can be, twice the lesser of that and like_words()."""
    return min(1.0, 2 * min(battery(x, size), like_words(s))) if name in WORDY else battery(x, size)


def p_value(s: str, name: str, x: np.ndarray, size: int, null: Prose) -> float:
    """p-value of s being a name or words: twice the lesser of two, that its letters follow each other so seldom in text and that a string
    of DIGITS digits has so many; 1 if the battery of tests shows that s isn't random."""
    if randomness(s, name, x, size) < RANDOM:
        return 1.0
    d, n = sum(c.isdigit() for c in s), len(s)
    q = sum(math.comb(n, k) * DIGITS**k * (1 - DIGITS) ** (n - k) for k in range(d, n + 1)) if n <= 400 else 0.5 * math.erfc((d - n * DIGITS) / math.sqrt(2 * n * DIGITS * (1 - DIGITS)))
    return min(1.0, 2 * min(null.p_text(s), q))


def length_bin(n: int) -> int:
    return n.bit_length()  # strata double in length


def scan(text: str, null: Prose) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Base spans (start, kind, end), sorted; candidates (start, end, stratum, p-value bin, hash) that base spans don't cover whole."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more, at, to = [], 0, 0  # base spans before `at` end before the candidate or were followed up to `to`
    for m in CANDIDATE.finditer(text):
        if found := encoding_of(m[0]):
            name, x, size = found
            while at < len(base) and base[at][0] <= max(to, m.start()):
                to = max(to, base[at][2])
                at += 1
            if to >= m.start() + len(x):
                continue
            stratum = length_bin(len(x)) * len(ENCODINGS) + [e[0] for e in ENCODINGS].index(name)
            more.append((m.start(), m.end(), stratum, min(P_BINS, int(-20 * math.log10(max(p_value(m[0], name, x, size, null), 1e-300)))), xxhash.xxh3_64_intdigest(m[0]) - 2**63))
    return base, more


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """One row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are those of the three patterns. Of other runs of 20 or more characters in which an encoding is recognised,
    those are held to be secrets that the battery of randomness tests accepts and that are told from names and words: by the
    serial dependence of their letters, against that of the words of all documents, or by their digits. A
    Benjamini-Hochberg procedure goes over the p-values of all different candidates of a stratum (encoding, and length by powers of
    two) in all documents, so that of the strings reported of each length a share of about `rate` at most is names or words, and
    short strings aren't judged by the many long ones. P-values are counted in bins rounded up. Null and empty texts have
    no spans; equal texts have equal ones; repeated or null ids do no harm; other columns are not read.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [scan(t or "", null) for t in part.column("text").to_pylist()]
                counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
                spans = [[f"{KINDS[k]}:{a}:{b}" for a, k, b in base] for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in spans]),
                     pa.array([[{"start": a, "kind": k, "stop": b} for a, k, b in base] for base, _ in found], kind_of_base), pa.array([[dict(zip(("start", "stop", "stratum", "bin", "hash"), c, strict=True)) for c in more] for _, more in found], kind_of_more)],
                    ["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "more"],
                )

    kind_of_base = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
    kind_of_more = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32()), ("hash", pa.int64())]))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    null = prose(source)
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start: long, kind: int, stop: long>>, more array<struct<start: long, stop: long, stratum: int, bin: int, hash: long>>"
    found = stored(source.mapInArrow(run, schema), "secrets")
    # a bin b holds p-values of 10 ** -(b / 20) at most: the largest such p within rate * rank / all reports all below it
    once = found.select(F.explode("more").alias("c")).select("c.stratum", "c.bin", "c.hash").distinct()  # a string counts once, however many copies
    bins = once.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))  # strata times bins at most
    w = Window.partitionBy("stratum")
    ranked = bins.withColumn("rank", F.sum("n").over(w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    cut = ranked.groupBy("stratum").agg(F.min(F.when(F.pow(F.lit(10.0), -F.col("bin") / 20) <= F.lit(rate) * F.col("rank") / F.col("all"), F.col("bin"))).alias("bin")).where("bin is not null")
    one = cut.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bin"))).alias("cut"))
    found_from = one.first()["cut"] or {}  # a stratum an entry: encodings times lengths
    limit = F.create_map(*(F.lit(x).cast("int") for kv in found_from.items() for x in kv)) if found_from else F.create_map().cast("map<int,int>")
    kept = F.filter("more", lambda c: F.coalesce(c["bin"] >= F.try_element_at(limit, c["stratum"]), F.lit(False)))
    whole = F.array_sort(F.concat("base", F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(whole, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    return found.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secrets": op3_secrets}
