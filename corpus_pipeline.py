"""A corpus pipeline of five stages: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontaminate, ngram_join, packing, quality_classifier, quality_rules
from scriptorium.llm.queries import vocabulary
from scriptorium.plans.store import materialise, scoped
from scriptorium.sources.tables import table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3 go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3, folds=5, held_out=0)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; boilerplate lines go from the others."""
    return quality_rules.clean(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays: that of the least id."""
    return ngram_join.keep_one(docs, threshold=0.8, size=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), size=13, share=20)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary(pieces=100_000), capacity=1024, end_id=2)


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py holds run()
#: against a brute-force version of every stage.
ORACLE_SQL = None


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
