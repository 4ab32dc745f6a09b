"""From raw documents to a training mix: judge, clean, deduplicate, decontaminate and weigh.

Each stage takes what the one before it wrote, in full, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.llm import decontaminate, line_dedup, mixing, quality, simhash
from reelsift.llm.common import read
from reelsift.session import materialise


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document has."""
    done = line_dedup.line_dedup(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return done.withColumns(new).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    checked = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return checked.filter(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws, a row for each piece, with its shard and place.

    ``n_chars`` is that of the piece.
    """
    return mixing.mixed(docs).withColumn("n_chars", F.char_length("text").cast("long"))


STAGES = [
    ("quality classifier", judge),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
]

ORACLE_SQL = None  # scores, fingerprints and draws have no SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return materialise(STAGES[-1][1](spark, docs, sf_dir))
