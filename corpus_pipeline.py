"""The training-data pipeline: five stages from raw documents to a mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Between stages the rows are written as
Parquet, so that no stage depends on the lineage of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontamination, jaccard_join, mixing, pii, quality_classifier
from llm.common import saved, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled rows among them, accepts."""
    model = quality_classifier.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle sets that are 80 percent alike."""
    return jaccard_join.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts."""
    return decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, becomes a placeholder."""
    return pii.redact_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time a document is drawn."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the classifier's fit, the transducers or the bisection: tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
