"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents, whatever
else a table of documents holds. Stages may be chained as they are; where a stage's result is written first, as `run` does, it is
computed once instead of each time the next stage reads it. What a stage needs besides its input is small and stays with the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackframe.llm import packing, quality, simhash, substring_dedup
from trackframe.llm.common import materialize, table
from trackframe.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a 5-word shingle similarity of 0.8 or more, the smallest doc_id stays."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 20 words or more go; the first occurrence stays."""
    return substring_dedup.dedup(docs, report=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a training sequence."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", passage_dedup), ("packing", pack)]

#: SQL has neither the fingerprints nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = materialize(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
