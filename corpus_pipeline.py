"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Every stage takes all documents that the one before kept. The first three return the
columns of the documents; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eponym.llm import op1_packing, op3_toxicity, op5_jaccard, op6_quality_rules
from eponym.llm.common import checkpointed, table
from eponym.llm.tokens import WORD_TOKENIZER, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return op6_quality_rules.keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents; the model learns from the labelled ones among ``docs``."""
    model = op3_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op3_toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group whose five-word shingles are 80 % alike."""
    return op5_jaccard.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return op1_packing.pack(docs, tokenizer_path(WORD_TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: No SQL: a trained model and a tokenizer are in it. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; what each keeps is written once to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
