"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import decontam, langid, packing, simhash, toxicity
from meterline.llm.common import staged, table
from meterline.shared import clear_staged, staged_paths


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language no profile can tell, go."""
    return langid.keep_identified(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples are toxic go."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth is benchmark text go."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's text gets its place in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Fingerprints, cosines and best fit have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it has written; what a stage has staged goes once its result is written."""
    docs, since = table(spark, sf_dir, "documents"), len(staged_paths)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_staged(spark, since, but=1)
    return docs
