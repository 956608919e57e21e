"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ftrl import Ftrl, scores, softmax, temperature
from .vectext import cuts, hashes, runs

BITS = 18
DIMS = 1 << BITS
_WORD = np.zeros(256, bool)
_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
STEMS = (4, 5, 6)  # bytes of a word's beginning that are features too


def features(texts: list[str]) -> list[np.ndarray]:
    """For each text the different hashed words and word beginnings, sorted."""
    parts = [t.lower().encode() for t in texts]
    buf = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, ends = runs(_WORD[buf])
    doc = np.searchsorted(np.cumsum([0, *(len(p) + 1 for p in parts)]), starts, "right") - 1
    found = []
    for n in (0, *STEMS):
        use = ends - starts > n
        h = hashes(buf, starts[use], starts[use] + n if n else ends[use]) + np.uint64(n)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)
        found.append(doc[use] << BITS | h.astype(np.int64))
    all_ = np.unique(np.concatenate(found))
    return np.split(all_ & (DIMS - 1), np.searchsorted(all_ >> BITS, np.arange(1, len(texts)))) if texts else []


class Chain:
    """Models of the categories in order; column DIMS + i of a row is the probability of category i."""

    def __init__(self, categories: list[str], weights: list[np.ndarray], temperatures: list[float], thresholds: list[float]):
        self.categories, self.weights, self.temperatures, self.thresholds = categories, weights, temperatures, thresholds

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.categories)))
        for k, (w, t) in enumerate(zip(self.weights, self.temperatures, strict=True)):
            s = np.array([w[at].sum(axis=0) for at in rows]).reshape(len(rows), 2) + w[DIMS + len(self.categories)]
            s += out[:, :k] @ w[DIMS : DIMS + k]
            out[:, k] = softmax(s / t)[:, 1]
        return out


def _rows(at: list[np.ndarray], before: np.ndarray, k: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    extra = np.append(np.arange(DIMS, DIMS + k), DIMS + size)  # earlier categories, and a constant
    return [(np.concatenate([a, extra]), np.concatenate([np.ones(len(a)), before[i, :k], [1.0]])) for i, a in enumerate(at)]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the probabilities where the F1 of what lies above is greatest; one half without positives."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    if not len(y) or not hit[-1]:
        return 0.5
    k = int(np.argmax(2 * hit / (np.arange(1, len(y) + 1) + hit[-1])))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(y) else 0.0)) / 2)


def fit_chain(at: list[np.ndarray], labels: np.ndarray, categories: list[str], folds: int = 3, epochs: int = 3) -> Chain:
    """The chain's models; those of later categories are trained with out-of-fold probabilities of the earlier ones, as
    a model's opinion of its own training rows is better than it will be of others. The out-of-fold scores also give
    each category's temperature, and the threshold of the best F1."""
    n, size = len(at), len(categories)
    fold, before = np.arange(n) % folds, np.zeros((n, size))
    weights, temperatures, thresholds = [], [], []
    model = lambda: Ftrl(DIMS + size + 1, 2, alpha=0.5, l1=5.0, l2=0.1)
    for k in range(size):
        rows, ys = _rows(at, before, k, size), labels[:, k].tolist()
        s = np.zeros((n, 2))
        for f in range(folds):
            fit, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w = model().fit([rows[i] for i in fit], [ys[i] for i in fit], epochs)
            s[out] = scores(w, [rows[i] for i in out])
        temperatures.append(temperature(s, labels[:, k]))
        before[:, k] = softmax(s / temperatures[-1])[:, 1]
        thresholds.append(best_threshold(before[:, k], labels[:, k]))
        weights.append(model().fit(rows, ys, epochs).astype(np.float32))
    return Chain(categories, weights, temperatures, thresholds)


def train(docs: DataFrame, labels: DataFrame, *, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 9000) -> Chain:
    """A chain for the categories, given in order as name: SQL condition on the columns of labels.

    It is fitted on a bounded sample of the labelled documents, the sample_rows of the least hash of their id. Only hashed
    features of the sample come to the driver. Labels of no document, documents of no label and null texts aren't learned
    from; a null condition counts as false; a document with several labels or copies is drawn once for each.
    """
    known = labels.select(F.col(id_col).alias("id"), *(F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())))
    total = known.join(docs.select(F.col(id_col).alias("id")), "id").count()  # labels of no document don't count
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    drawn = known.withColumn("draw", draw).where(F.col("draw") < int(min(1.0, 1.5 * sample_rows / max(1, total)) * (1 << 40)))
    names = [f"y{i}" for i in range(len(categories))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(min(1.0, 1.5 * sample_rows / max(1, total)) * (1 << 40))))

    def sparse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            done = 0
            for to in cuts(batch.column("text"), 1 << 20):
                part = batch.slice(done, to - done)
                done = to
                at = features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("draw", *names)), pa.array([a.astype("<u4").tobytes() for a in at], pa.binary())], ["draw", *names, "at"])

    got = rows.join(drawn, "id").select("draw", *names, "text").mapInArrow(sparse, ", ".join(["draw long", *(f"{c} int" for c in names), "at binary"]))
    sample = sorted(((r.draw, r.at, tuple(r[c] for c in names)) for r in got.toLocalIterator()))[:sample_rows]
    at = [np.frombuffer(a, "<u4").astype(np.int64) for _, a, _ in sample]
    return fit_chain(at, np.array([y for *_, y in sample], int).reshape(len(at), len(names)), list(categories))


def classified(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, and p_<category> and is_<category> for each category.

    Whole texts are read. Null, empty and wordless texts have no features and get the chain's constant; equal texts get
    equal probabilities; rows are not joined, so repeated or null ids do no harm. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names, flags = [f"p_{c}" for c in chain.categories], [f"is_{c}" for c in chain.categories]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            done = 0
            for to in cuts(batch.column("text"), 1 << 20):
                part = batch.slice(done, to - done)
                done = to
                p = sent.value.predict(features([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), *(pa.array(p[:, k] >= t) for k, t in enumerate(sent.value.thresholds))], ["id", *names, *flags])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, ", ".join([f"id {source.schema['id'].dataType.simpleString()}", *(f"{c} double" for c in names), *(f"{c} boolean" for c in flags)])).withColumnRenamed("id", id_col)


#: In the order of the chain; conditions on the columns of the table labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 AND quality = 0"}


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_<category> for the three categories, toxic (the decision on that category) and those on the others."""
    docs = table(spark, sf_dir, "documents")
    return classified(docs, train(docs, table(spark, sf_dir, "labels"), categories=CATEGORIES)).withColumnRenamed("is_toxic", "toxic")


QUERIES = {"op4_toxicity": op4_toxicity}
