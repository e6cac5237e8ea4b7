"""From raw documents to packed training sequences: language, repeated lines, near copies, mix, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import langid, line_dedup, mixing, ngram_join, packing
from lumisift.llm.common import long_rows, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those too far from every language's centroids go."""
    model = langid.fit(docs.filter(~langid.held_out(docs["doc_id"])))
    return langid.identify(docs, model).filter("NOT rejected").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in 10 or more of them; n_chars follows the text."""
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_near_duplicates(docs, n=5, threshold=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; workers carry memory of four stages, so few words are kept."""
    return packing.pack(docs, length=4096, end_id=2, words_kept=120_000)


def _batched(stage):
    """The stage with Arrow batches fit for texts."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        long_rows(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _batched(language_id)),
    ("line_dedup", _batched(line_dedup_stage)),
    ("ngram_join", _batched(ngram_join_stage)),
    ("mixing", _batched(mixing_stage)),
    ("packing", _batched(packing_stage)),
]

# The classifier, the mix and the packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
