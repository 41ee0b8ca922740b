"""A corpus from `documents`: quality, exact and near duplicates, source weights, sequences.

Every stage takes (spark, docs, sf_dir), docs being the stored result of the stage before, and
returns its result; all but the last return the columns of `documents`. A document that the mix
takes twice is there twice.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keystride.llm import exact_dedup, mixing, near_dedup, packing, quality
from keystride.llm.common import table
from keystride.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, width=near_dedup.WIDTH)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
    ("mixing", mixing_stage), ("packing", packing_stage),
]
#: The perplexities, the near duplicates and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
