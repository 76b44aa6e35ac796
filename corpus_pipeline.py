"""From raw documents to token counts: five stages, each on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``documents``, further columns of the input included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import bpe, decontamination, language, quality, simhash
from tallyframe.llm.common import fresh, settle, table

#: Documents are kept from this probability of their language, and this score of quality, on.
LEAST_LANGUAGE_SCORE, LEAST_QUALITY = 0.35, quality.THRESHOLD


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that no known language fits."""
    names = (fresh(docs, "lang_pred"), fresh(docs, "score"))
    found = language.with_languages(docs, language.fit(docs), names=names)
    known = (F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(*docs.columns)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of low quality."""
    name = fresh(docs, "score")
    found = quality.with_scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")), name=name)
    return found.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.encoded_documents(docs)


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: The classifiers and the encoding cannot be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
