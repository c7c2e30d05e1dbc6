"""A corpus from quality filter to packed sequences, five operators one after another.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of ``documents``;
the table that one returns is written as Parquet and read again as the next one's ``docs``.

Defined cases of every stage: a null text is an empty one and stays null; null and repeated ids are rows like others; further columns of
any name go through (the last stage returns its own); an empty table stays empty; very long texts are read whole, by one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.llm import decontamination, line_dedup, ngram_join, packing, quality
from sumfold.llm.common import free, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels outside its held-out fold, takes for good.

    Equal texts stay or go together; empty texts are scored as such; without labels of both classes all have the share of good ones, and
    go if that is below one half.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model)
    return scored.where("score >= 0.5").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; a document of nothing else goes.

    Of equal runs the one that comes first by id (null first), then by row and line, stays; an empty text, which has no line to lose, stays;
    ``n_chars`` follows the text.
    """
    n_lines, n_removed = counts = tuple(free(docs.columns, x) for x in ("n_lines", "n_removed"))
    out = line_dedup.dedup(docs, counts=counts)
    return out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines))).drop(*counts)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The one with the least id stays, of rows that tie one; documents without words are no copies of each other and stay.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages.

    A document without words stays; benchmark rows that are null or without words contaminate nothing; equal texts stay or go together.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids and these ids' CRC-32.

    An empty or null text is its end id; rows of one id are documents of their own.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: a fitted classifier and a tokenizer are part of it. Tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
