"""The corpus pipeline: stages over documents, each written and read again.

quality_rules     drops documents that the quality rules reject
near_duplicates   keeps one document, that with the least id, of each class
substring_dedup   takes repeated passages out of the texts
source_mixing     samples documents towards the target mix
best_fit_packing  packs what is left into sequences, one row per piece

ORACLE_SQL is None: neither tokeniser fertility nor signatures can be put in SQL.

Null texts are empty, which the quality rules reject; null ids count as the largest
id. Of repeated rows one stays. Ties and very long texts are as the operators' own
modules say: no stage cuts a text. An empty table gives no rows. Extra columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanwork.llm import fertility, mixing, near_dups, packing, substrings
from gleanwork.runtime import Scratch, attach, workspace

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    attach(spark)
    return fertility.keep_good(docs, added=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    attach(spark)
    return near_dups.keep_first(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    attach(spark)
    return substrings.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    attach(spark)
    return mixing.mix(docs, added=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    attach(spark)
    return packing.pack_documents(docs, added=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near),
    ("substring_dedup", substring),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables of the others go as soon as the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        with workspace(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            scratch.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
