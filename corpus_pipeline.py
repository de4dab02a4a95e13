"""A corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`, and what a stage drops or changes is gone for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import language_id, near_dedup, packing, quality, substring_dedup
from weftgraph.llm.common import documents, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the threshold table.

    Null and empty texts have no words and go; a measure at a bound passes; repeated rows
    are judged each; long texts are read whole; an empty table stays empty; all columns
    keep their values.
    """
    return quality.accepted(docs)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the documents' own labels teach.

    Null texts and those without a letter go, and so does all if no row has a label; ties
    between languages go; repeated rows are judged each; long texts are read whole; an empty
    table stays empty; all columns keep their values.
    """
    model = language_id.learn(language_id.training_rows(docs))
    return language_id.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id.

    Null ids all stay; null texts count as empty, and those without words are one group; of
    rows that share the least id that with the least text stays; long texts are read whole;
    an empty table stays empty; all columns keep their values.
    """
    return near_dedup.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows the text.

    Null texts become empty ones, with n_chars 0; rows that share an id are no earlier than
    each other; long texts are read whole; an empty table stays empty; all other columns keep
    their values.
    """
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.

    Null texts count as empty and give their end id; repeated rows are packed each; long
    texts are cut, never shortened; an empty table gives no pieces; other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_filter),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: Language scores, SimHash links and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each but the last written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
