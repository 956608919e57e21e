"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .ftrl import Ftrl, scores, softmax, temperature
from .vectext import cuts

DIMS = 1 << 14


def _fold(c: int) -> int:
    """Letters to lower case where that is one letter; anything else is a space."""
    x = chr(c)
    low = x.lower()
    return (ord(low) if len(low) == 1 else c) if x.isalpha() else 32


_FOLD: list[np.ndarray] = []


def folded(codes: np.ndarray) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(np.array([_fold(c) for c in range(1 << 16)], np.uint32))
    out = _FOLD[0][np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):  # rare planes
        out[i] = _fold(int(codes[i]))
    return out


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, letters): hashed 1- to 3-grams of each text, DIMS columns, and how many letters it has.

    Runs of other characters count as one space; n-grams reach to the end of their text and no farther.
    """
    codes = np.frombuffer("\0\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    end = np.zeros(len(codes), bool)
    end[ends - 1], end[ends - 2] = True, True
    c = folded(codes)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | end[1:] | end[:-1]
    c, doc, end = np.where(end, 0, c)[keep].astype(np.uint64), doc[keep], end[keep]
    letters = np.bincount(doc[(c != 32) & ~end], minlength=len(texts))
    out = np.zeros(len(texts) * DIMS, np.float32)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] * np.uint64(31) + np.roll(one, -1)[:-1] + np.uint64(1) if len(c) > 1 else one[:0]
    three = (one[:-2] * np.uint64(961) + one[1:-1] * np.uint64(31) + one[2:] + np.uint64(2)) if len(c) > 2 else one[:0]
    for h in (one, two, three):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)
        live = ~end[: len(h)]
        out += np.bincount((doc[: len(h)] * DIMS + h.astype(np.int64))[live], minlength=len(out))
    return out.reshape(len(texts), DIMS), letters


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def batches_of(texts: pa.Array, size: int = 1 << 18, most: int = 64) -> Iterator[tuple[int, int]]:
    at = 0
    for to in cuts(texts, size):
        yield from ((i, min(i + most, to)) for i in range(at, to, most))
        at = to


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts, letters = ngram_counts([t or "" for t in texts])
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(tf_idf(counts, self.idf) @ self.weights / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, p.max(axis=1), 0.0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 3000) -> Model:
    """A model of the labelled rows of docs, which are to be learned from all.

    Document frequencies cover all of them. The regression is fitted on a bounded sample: for each language up to
    sample_rows / languages rows, those of the least hash; of these every fifth is kept for the temperature. Only hashed
    n-gram counts of the sample come to the driver, and a count for each language; the model has DIMS weights for each.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")

    def frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in parts:
            text = batch.column("text")
            for a, b in batches_of(text):
                total += (ngram_counts(text.slice(a, b - a).to_pylist())[0] > 0).sum(axis=0)
                n += b - a
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIMS), -1)), pa.array(np.append(total, n))], ["h", "n"])

    df = np.zeros(DIMS)
    n = 0
    for r in rows.select("text").mapInArrow(frequencies, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.h < 0:
            n = r.n
        else:
            df[r.h] = r.n
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if not sizes:
        return Model([], idf, np.zeros((DIMS, 0)), 1.0)
    languages = sorted(sizes)
    each = max(5, sample_rows // len(languages))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    below = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 2 * each / sizes[lang]) * (1 << 40))) for lang in languages], "lang string, below long")
    below = F.broadcast(below) if len(languages) <= 100_000 else below  # a name and a number each
    small = rows.withColumn("draw", draw).join(below, "lang").where("draw < below")

    def sparse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            text = batch.column("text")
            for a, b in batches_of(text):
                x = tf_idf(ngram_counts(text.slice(a, b - a).to_pylist())[0], idf)
                at = [np.flatnonzero(v) for v in x]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), batch.column("draw").slice(a, b - a), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([v[i].astype("<f4").tobytes() for i, v in zip(at, x, strict=True)], pa.binary())], ["lang", "draw", "at", "x"])

    got: dict[str, list] = {lang: [] for lang in languages}
    for r in small.select("text", "lang", "draw").mapInArrow(sparse, "lang string, draw long, at binary, x binary").toLocalIterator():
        got[r.lang].append((r.draw, (np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float))))
    fit, held = [], []
    for y, lang in enumerate(languages):
        for i, (_, x) in enumerate(sorted(got[lang], key=lambda d: (d[0], d[1][0].tobytes()))[:each]):
            (held if i % 5 == 4 else fit).append((x, y))
    w = Ftrl(DIMS, len(languages), alpha=0.5, l1=0.02, l2=0.1).fit([x for x, _ in fit], [y for _, y in fit])
    t = temperature(scores(w, [x for x, _ in held]), np.array([y for _, y in held], int))
    return Model(languages, idf, w.astype(np.float32), t)


def identified(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep of docs, with lang_pred and score.

    lang_pred is a learned language, or `und` with score 0 where the text is null, empty or without any letter, and for a
    model of no languages. Texts are read whole, whatever their length. Equal texts get equal predictions. The names
    lang_pred, score and _text among keep are a ValueError.
    """
    if clash := {"lang_pred", "score", "_text"} & set(keep):
        raise ValueError(f"{sorted(clash)} can't be kept: rename them first")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            text = batch.column("_text")
            for a, b in batches_of(text):
                lang, score = sent.value.predict(text.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    source = docs.select(*(F.col(k) for k in keep), F.col(text_col).alias("_text"))
    kept = [f for f in source.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double"])
    return source.mapInArrow(run, schema)


def of_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without those of no language: text null or without a letter, or no language with a calibrated score of `least`.

    The model learns from docs' own labels, of the rows whose crc32(doc_id) mod 3 isn't 1. Where none of these has a label,
    there is no language to tell, and all docs are kept.
    """
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)))
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    model = train(plain.where(~F.coalesce(remainder(F.col(at["doc_id"])) == 1, F.lit(False))), id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"])
    rows = identified(plain, model, text_col=at["text"], keep=tuple(at.values()))
    if model.languages:
        rows = rows.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return rows.select(*(F.col(x).alias(c) for c, x in at.items()))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"))
    return identified(docs, train(docs.where(~F.col("held_out"))), keep=("doc_id", "held_out"))


QUERIES = {"op2_language": op2_language}
