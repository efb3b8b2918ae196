"""A training-data pipeline over documents: STAGES, each written as Parquet and reread as the next one's docs.

Quality rules, toxicity and decontamination drop the documents that they reject, the n-gram join keeps one document of
each component of near copies, and packing returns a row for each piece of what is left. Every stage but the last
returns the columns of its input, whatever their names.

Null and empty texts have no words and go with the quality rules; a null source is a host of its own. A very long text is
read whole in every stage. Rows with a null id stay up to packing and keep the null there; of rows that repeat an id, which
are judged one by one before, the n-gram join keeps the one of the least hash. Of texts with equal shingles and of linked
near copies the document with the least id stays. An empty table gives empty stages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom import runtime
from textloom.llm import decontaminate, ngram_join, packing, quality_rules, registry, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def relieved(stage: Stage) -> Stage:
    """The stage, begun with executors that gave back the heap of the one before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        runtime.relieve(spark)
        return stage(spark, docs, sf_dir)

    return run


@relieved
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


@relieved
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chain is trained on the labelled rows of the whole table, not only on those that are left."""
    labelled = registry.table(spark, sf_dir, "documents")
    return toxicity.keep(docs, toxicity.fit(labelled, registry.table(spark, sf_dir, "labels")))


@relieved
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep(docs)


@relieved
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, registry.table(spark, sf_dir, "benchmark"))


@relieved
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, registry.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]
#: Trained models and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the table documents."""
    docs = registry.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = runtime.stored(stage(spark, docs, sf_dir), "stage")
    return docs
