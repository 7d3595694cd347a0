"""From documents to training sequences: language ID, quality rules, near copies, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sigtrace import session
from sigtrace.llm import jaccard, langid, mixing, packing, quality
from sigtrace.llm.queries import vocabulary
from sigtrace.llm.textops import keep_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; null texts, texts without letters and unsure ones go."""
    model = langid.train(docs)
    return keep_rows(docs, lambda own: langid.accepted(model, own))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose compression stays in its bands."""
    return keep_rows(docs, quality.passes)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, by row: null and repeated ids included; rows without words all stay."""
    return jaccard.first_rows(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: full repetitions of documents as rows of their own, a partial one with the text's first words."""
    return mixing.repeat(mixing.mix(docs)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece."""
    return packing.best_fit_packing(docs, vocabulary(), 2048)


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("n-gram Jaccard join", ngram_jaccard),
          ("mixing sources to target weights", source_mixing), ("best-fit packing", best_fit_packing)]

#: Classifier, compression and packing are beyond SQL; the test rebuilds the run by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{session.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
