"""A training-corpus pipeline: language, near-duplicates, benchmark passages, mixture, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's docs. All but the last
keep the columns of documents. Each stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import decontaminate, langid, mix, simhash, wavelet_tokens
from auditloom.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go."""
    return langid.of_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages are cut out of the others."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt to files in the order of the mixture of their sources."""
    return mix.in_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture (worked out anew, as a table doesn't promise its order); per document, read
    back from them: doc_id, start, n_tokens, ids_crc32."""
    ordered = mix.with_places(docs.select("doc_id", "source", "text"), "place")
    return wavelet_tokens.read_tokens(wavelet_tokens.token_files(ordered, order_col="place", total_bytes=wavelet_tokens.bytes_of(docs))).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixture", mixture),
    ("token files", tokens),
]
ORACLE_SQL = None  # SQL can't express the stages; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
