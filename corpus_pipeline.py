"""Corpus pipeline: quality, language, line deduplication, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last
returns the packed pieces. Further columns of docs pass through as they are, whatever they are called. run() writes each
stage's result to the shared folder before the next reads it, and deletes what the stage itself has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import langid, line_dedup, packing, quality, simhash
from pitlake.llm.common import WORD, cut, free, release, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned on the labelled ones among them, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = free(docs, "score", "predicted")
    return quality.score(docs, model, names=(score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of one half or more; those without a letter go."""
    lang, score = free(docs, "lang_pred", "score")
    found = langid.identify(docs, langid.fit(docs), (lang, score))
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= 0.5)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later copies; one that lost lines and has no word left goes. n_chars follows the text."""
    lines, gone = free(docs, "n_lines", "cut")
    found = line_dedup.dedup_lines(docs, names=(lines, gone))
    changed = F.size(gone) > 0
    found = found.where(~changed | F.col("text").rlike(WORD))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, rows without an id last."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences of 2048 words, by best fit."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_a_group),
    ("packing", pack),
]

#: Learned models and best-fit bins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    others = set(written())
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        mine = [p for p in written() if p not in others]
        release(spark, mine[:-1])  # all but the stage's result: its own steps and the result before
    return STAGES[-1][1](spark, docs, sf_dir)
